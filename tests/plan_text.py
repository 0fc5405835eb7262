"""Plan texts for tests and the plan report."""

from __future__ import annotations


def without_initial_plans(text: str) -> str:
    """The executed plan, subqueries and cached tables included, without the
    adaptive plans' "Initial Plan" parts."""
    out, at = [], None
    for line in text.splitlines():
        if at is not None and line[: at + 3].strip(" :") == "":
            continue
        at = line.find("+- == Initial Plan ==")
        if at < 0:
            at = None
            out.append(line)
    return "\n".join(out)


def final_plan(df) -> str:
    df.collect()
    return without_initial_plans(df._jdf.queryExecution().executedPlan().toString())
