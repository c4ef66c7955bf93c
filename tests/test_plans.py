"""Plan-shape checks over every registered batch query (sf0.001)."""

import __spark_entry__ as E

# Filters Catalyst pushes below a JSON-parsing projection evaluate the parse a
# second time (outside whole-stage codegen).  No query is exempt.
JSON_IN_FILTER_ALLOWED: set[str] = set()


def _json_filters(plan: str) -> list[str]:
    return [line for line in plan.splitlines()
            if line.strip().lstrip(":+- ").startswith("Filter")
            and ("from_json" in line or "get_json_object" in line)]


def test_no_json_parse_inside_filters(spark, sf_small):
    offenders = {}
    for name, build in E.queries().items():
        if name.startswith("stream_") or name in JSON_IN_FILTER_ALLOWED:
            continue  # streaming keys run their query while being built
        plan = build(spark, sf_small)._jdf.queryExecution().optimizedPlan().toString()
        hits = _json_filters(plan)
        if hits:
            offenders[name] = hits[0][:160]
    assert offenders == {}
