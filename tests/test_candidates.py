"""What hints take, found once for all queries that have them."""

import datetime as dt
import random
import re

import pytest

from tessera.operators import retrieval


@pytest.mark.parametrize("sent", [100_000, 0])
def test_hints_of_many_queries(spark, monkeypatch, sent):
    monkeypatch.setattr(retrieval, "MOST_SENT", sent)
    rng = random.Random(4)
    day = lambda d: dt.date(2024, 1, 1) + dt.timedelta(days=d)
    rows = [(f"m{i:03d}", f"u{rng.randrange(6)}" if i % 17 else None, f"{day(rng.randrange(8))}T0{rng.randrange(4)}:00:00", [1.0, float(i)]) for i in range(150)]
    asked = []
    for q in range(40):
        a = rng.randrange(8)
        span = (day(a), day(a + rng.randrange(-1, 5)), rng.choice([3, 20])) if q % 7 else (None, None, None)
        asked.append((q, [1.0, 0.0] if q % 5 else None, "x", f"u{rng.randrange(7)}" if q % 3 else None, *span))
    m = spark.createDataFrame(rows, "memory_id string, who_id string, when_ts string, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id int, query array<double>, text string, actor string, first date, last date, cap int")
    got = retrieval.candidates(m, q, k=2, actor_cap=7)
    newest = sorted(sorted(rows), key=lambda r: r[2], reverse=True)
    for source, want in (
        ("actor", {(i, r[0]) for i, _, _, who, *_ in asked if who for r in [x for x in newest if x[1] == who][:7]}),
        ("temporal", {(i, r[0]) for i, _, _, _, a, z, cap in asked if cap for r in [x for x in newest if str(a) <= x[2][:10] <= str(z)][:cap]}),
    ):
        assert {(r.query_id, r.memory_id) for r in got.where(f"{source} = 1.0").collect()} == want
    tops = re.findall(r"\+- Window \[row_number\(\)[^\n]*? AS n#\d+\], \[([^\]]*)\]", got._jdf.queryExecution().optimizedPlan().toString())
    assert any("first#" in x for x in tops) and any("hint#" in x for x in tops) and not any("source#" in x for x in tops), tops
