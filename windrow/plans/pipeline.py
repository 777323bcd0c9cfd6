"""The whole dataflow on a table of payloads."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windrow.operators.codecs import (
    JSON_FAULTS,
    avro_faults,
    carried_names,
    observe_outcomes,
    observed_outcomes,
    reject_summary,
    split_decoded,
    tag_avro,
    tag_json,
)
from windrow.operators.count_windows import count_windows
from windrow.operators.metrics import (
    invalid_metrics,
    keep_metric,
    metrics_of,
    valid_metrics,
    validate,
)
from windrow.schemas import SENSOR_DATA
from windrow.sinks.lines import average_lines, invalid_lines, valid_lines
from windrow.storage import materialize as write_once

# Topic names of the dataflow.
READINGS = "sensordata"
METRICS = "metics"
VALID = "valid-metics"
INVALID = "invalid-metics"
ROTOR = "rotor-data"
ROTOR_METRIC = "rotorSpeed"

INGRESS = ("json", "avro", "stream", "generic")


def tag_payloads(
    payloads: DataFrame, ingress: str, col: str = "payload", schema: T.StructType = SENSOR_DATA
) -> DataFrame:
    """Decode by the kind of ingress. "stream" is Avro read in limited batches, "generic" Avro of
    a schema given by the caller."""
    if ingress not in INGRESS:
        raise ValueError(f"ingress must be one of {INGRESS}")
    return tag_json(payloads, col) if ingress == "json" else tag_avro(payloads, col, schema)


def faults_of(ingress: str, schema: T.StructType = SENSOR_DATA) -> tuple[str, ...]:
    """The reasons that ``tag_payloads`` gives."""
    return JSON_FAULTS if ingress == "json" else avro_faults(schema)


def run_batch(
    payloads: DataFrame,
    ingress: str = "avro",
    *,
    order_by: list[str],
    col: str = "payload",
    n: int = 5,
    materialize: bool = True,
    with_averages: bool = True,
    record: T.StructType = SENSOR_DATA,
) -> dict[str, DataFrame]:
    """All topics and outputs by name. ``order_by`` names columns of the payload table.

    ``record`` is the schema of Avro payloads: readings, or metrics, which then need no flattening. "outcomes" counts
    the payloads kept and the rejects of each reason; if ``materialize``, in the pass that writes them.

    All outputs hang on the decoded payloads. These are written once if ``materialize``, with the
    raw payload of rejects only; otherwise each output that is used decodes anew, all in one stage
    with what follows. The averages need the order of all rows, so their rows are sorted at once, by
    this call; leave them out with ``with_averages=False``.
    """
    tagged = tag_payloads(payloads.select(*order_by, col), ingress, col, record)
    if materialize:
        rejected, seen = F.when(F.col("fault").isNotNull(), F.col(col)), Observation()
        tagged = observe_outcomes(tagged.withColumn(col, rejected), faults_of(ingress, record), seen)
        tagged = write_once(tagged, "decoded")
        counts = list(observed_outcomes(seen).items())
        outcomes = payloads.sparkSession.createDataFrame(counts, "outcome string, payloads bigint")
    else:
        outcomes = reject_summary(tagged)
    readings, rejects = split_decoded(tagged, col)
    order = carried_names(order_by, record)
    metrics = metrics_of(readings, record, keep=order)
    checked = validate(metrics)
    valid, invalid = valid_metrics(checked), invalid_metrics(checked)
    # same rows as keep_metric(valid, ...), without building the other metrics first
    rotor = valid_metrics(validate(metrics_of(readings, record, [ROTOR_METRIC], keep=order)))
    outputs = {
        READINGS: readings,
        METRICS: metrics,
        VALID: valid,
        INVALID: invalid,
        ROTOR: rotor,
        "rejects": rejects,
        "outcomes": outcomes,
        "valid-log": valid_lines(valid),
        "invalid-log": invalid_lines(invalid),
    }
    if with_averages:
        outputs["averages"] = count_windows(rotor, n, order_by=order)
        outputs["average-log"] = average_lines(outputs["averages"])
    return outputs


def rotor_topic(valid: DataFrame) -> DataFrame:
    """The rotor topic of a valid topic that is already there."""
    return keep_metric(valid, ROTOR_METRIC)
