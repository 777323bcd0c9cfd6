import re


def plan_nodes(df):
    """Names of the physical operators of a plan, top first."""
    text = df._jdf.queryExecution().executedPlan().toString()
    found = (re.match(r"[\s:+\-*()\d]*([A-Z]\w+)", line) for line in text.splitlines())
    return [m.group(1) for m in found if m]
