import pytest


@pytest.fixture(scope="session")
def rows(spark):
    """A frame of dicts with a DDL schema; missing keys are null."""

    def make(schema, *dicts):
        names = [c.strip().split(" ", 1)[0] for c in _top(schema)]
        return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], schema)

    def _top(schema):
        out, depth, cur = [], 0, ""
        for ch in schema:
            depth += (ch == "<") - (ch == ">")
            if ch == "," and depth == 0:
                out.append(cur)
                cur = ""
            else:
                cur += ch
        return [*out, cur]

    return make
