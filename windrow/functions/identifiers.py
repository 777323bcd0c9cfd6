"""UUID text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex digits per group of a canonical UUID.
GROUP_WIDTHS = (8, 4, 4, 4, 12)

_CANONICAL = "^" + "-".join(f"[0-9a-f]{{{w}}}" for w in GROUP_WIDTHS) + r"\z"
_ACCEPTED = "^" + "-".join(f"[0-9a-fA-F]{{1,{w}}}" for w in GROUP_WIDTHS) + r"\z"


def normalize_uuid(text: Column) -> Column:
    """Canonical lower-case UUID, or NULL if ``text`` is not one.

    Short groups are padded with zeros on the left; a group longer than its place is refused.
    Text that is canonical already skips the split.
    """
    groups = F.split(text, "-")
    padded = F.concat_ws(
        "-", *[F.lpad(groups.getItem(i), w, "0") for i, w in enumerate(GROUP_WIDTHS)]
    )
    return F.when(text.rlike(_CANONICAL), text).when(text.rlike(_ACCEPTED), F.lower(padded))
