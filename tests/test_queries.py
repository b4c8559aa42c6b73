"""Every registered query against its DuckDB equivalent, or that it runs."""

import duckdb
import pandas as pd
import pytest

from quern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object).where(lambda x: x.notna(), None)
    out = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLE_SQL:
        want = duck.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        a, b = rows(got), rows(want)
        assert len(a) == len(b)
        assert [tuple(map(str, x)) for x in a] == [tuple(map(str, x)) for x in b]
    else:
        assert len(got)


def test_alignments(spark, sf_dir):
    """Alignments cost as much as the distance and spell both sides; their counts are those of the registered queries."""
    from collections import Counter

    from quern.operators.score import DELETED, INSERTED, align

    short = [(r["item_id"], r["text"], r["text"].replace("th", "d").replace("on", "no")) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def distance(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    seen, counted = Counter(), {}
    for i, a, b in short:
        pairs = align(a, b)
        assert "".join(x for x, _ in pairs if x != INSERTED) == a and "".join(y for _, y in pairs if y != DELETED) == b
        assert sum(x != y for x, y in pairs) == distance(a, b)
        seen.update((x, y) for x, y in pairs if x != y)
        counted[i] = (sum(x != y and INSERTED != x and DELETED != y for x, y in pairs), sum(y == DELETED for _, y in pairs), sum(x == INSERTED for x, _ in pairs))
    got = registry.QUERIES["confusions"](spark, sf_dir).collect()
    assert {(r["src"], r["dst"]): r["n"] for r in got} == dict(seen) and [r["n"] for r in got] == sorted((r["n"] for r in got), reverse=True)
    assert {r["id"]: (r["substitutions"], r["deletions"], r["insertions"]) for r in registry.QUERIES["operation_counts"](spark, sf_dir).collect()} == counted


def test_votes(spark, sf_dir):
    """With two equal hypotheses among three the vote is theirs; the registered query's votes come from the three texts at each place."""
    from quern.operators.consensus import rover

    short = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r["id"]: r["voted"] for r in registry.QUERIES["rover_vote"](spark, sf_dir).collect()}
    for i, t in short:
        hyp, third = t.replace("th", "d").replace("on", "no"), t.replace("er", "e")
        assert rover([t, hyp, t], 1) == rover([hyp, t, t], 0) == t
        assert got[i] == rover([hyp, t, third], 0)


def test_long_chains(spark):
    """Rows linked in turn by two keys: every second one stays."""
    from quern.operators.quality import accept_in_order

    rows = spark.createDataFrame([(i, f"a{(i + 1) // 2}", f"b{i // 2}") for i in range(301)], "i long, a string, b string")
    for settle in (20_000, 260):
        assert {r["i"]: r["accepted"] for r in accept_in_order(rows, "i", ["a", "b"], settle).collect()} == {i: i % 2 == 0 for i in range(301)}
