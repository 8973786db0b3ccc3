"""Queries of the engine on the fixture memories, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import chunks, scoring as S, temporal, text as X
from tessera.operators import analytics as A, blocks as B, graph as G, liquid, minibatch, retrieval as R, store, vector
from tessera.sources import conversations as C, fixtures as fx
from tessera.sources.fixtures import AS_OF, MEM, QUERY_STEP

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a function of (spark, sf_dir); with the SQL for its rows, if any."""

    def take(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return take


def made(name: str, f, oracle: str | None = None) -> None:
    query(oracle, name)(f)


def mem(spark, sf) -> DataFrame:
    return fx.memories(spark, sf)


def asked(m: DataFrame, hint: str | None = None) -> DataFrame:
    """The query set: the vectors and actors of every QUERY_STEP-th memory, and a text that names the place. The date hint is the memory's day, or what
    the phrase says."""
    rows = m.where(F.col("vec_id") % QUERY_STEP == 0)
    day = F.to_date(F.substring("when_ts", 1, 10))
    own = F.struct(day.alias("first"), day.alias("last"), F.lit(temporal.DATE_CAP).alias("cap"))
    when = own if hint is None else temporal.window(temporal.hint(F.lit(hint), AS_OF), AS_OF)
    text = F.concat(F.lit("notes from "), F.col("where_value"), F.lit(" yesterday"))
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), text.alias("text"), F.col("who_id").alias("actor"), day.alias("day"), when.alias("w")).select("*", "w.*").drop("w")


COLS = "memory_id, session_id, who_id, where_value, when_ts, token_count"
COL = [c.strip() for c in COLS.split(",")]
ID3 = "('mem_000000000000','mem_000000000007','mem_000000000042','mem_none')"

# ---- store -------------------------------------------------------------------------------------


@query(f"{MEM} SELECT {COLS} FROM memories WHERE memory_id IN {ID3}")
def memory_lookup(spark, sf):
    ids = spark.createDataFrame([(x.strip("'"),) for x in ID3[1:-1].split(",")], "memory_id string")
    return store.lookup(mem(spark, sf), ids).select(*COL)


@query(f"{MEM} SELECT {COLS}, why, how FROM memories WHERE memory_id = 'mem_000000000042'")
def memory_get(spark, sf):
    return mem(spark, sf).where(F.col("memory_id") == "mem_000000000042").select(*COL, "why", "how")


_BROWSE = """WHERE (raw_text ILIKE '%an%' OR what ILIKE '%an%' OR why ILIKE '%an%' OR how ILIKE '%an%') AND (who_id ILIKE '%user%' OR coalesce(who_label,'') ILIKE '%user%' OR who_type ILIKE '%user%')
  AND (where_value ILIKE '%src1%' OR where_type ILIKE '%src1%') AND when_ts >= '2024-01-03' AND when_ts <= '2024-01-28'"""


@query(f"{MEM}, f AS (SELECT * FROM memories {_BROWSE}) SELECT {COLS}, (SELECT count(*) FROM f) AS total, ceil((SELECT count(*) FROM f) / 20.0)::BIGINT AS total_pages, true AS has_prev, ceil((SELECT count(*) FROM f) / 20.0) > 2 AS has_next FROM f ORDER BY when_ts DESC NULLS LAST, memory_id LIMIT 20 OFFSET 20")
def browse_filtered(spark, sf):
    rows = mem(spark, sf).where(store.matching(text="an", who="user", where="src1", since="2024-01-03", until="2024-01-28"))
    return store.page(rows.select(*COL), number=2, size=20)


_ACTOR = "(SELECT min(who_id) FROM memories)"


@query(f"{MEM} SELECT {COLS} FROM memories WHERE who_id = {_ACTOR} ORDER BY when_ts DESC, memory_id LIMIT 100")
def by_actor(spark, sf):
    m = mem(spark, sf)
    return store.by_actor(m, m.agg(F.min("who_id")).first()[0]).select(*COL)


@query(f"{MEM} SELECT {COLS} FROM memories WHERE where_value = 'src3' ORDER BY when_ts DESC, memory_id LIMIT 100")
def by_location(spark, sf):
    return store.by_location(mem(spark, sf), "src3").select(*COL)


@query(f"{MEM} SELECT count(*) > 0 AS found FROM memories WHERE who_id = 'user:nobody'")
def actor_exists(spark, sf):
    return store.exists(mem(spark, sf), F.col("who_id") == "user:nobody")


@query(f"{MEM} SELECT {COLS} FROM memories WHERE substr(when_ts,1,10) = '2024-01-15' ORDER BY when_ts DESC, memory_id LIMIT 200")
def by_date(spark, sf):
    return store.between_dates(mem(spark, sf), "2024-01-15", "2024-01-15").select(*COL)


@query(f"{MEM} SELECT {COLS} FROM memories WHERE substr(when_ts,1,10) BETWEEN '2024-01-10' AND '2024-01-12' ORDER BY when_ts DESC, memory_id LIMIT 200")
def by_date_range(spark, sf):
    return store.between_dates(mem(spark, sf), "2024-01-10", "2024-01-12").select(*COL)


for _hint, (_a, _b, _n) in store.RELATIVE.items():
    made(f"by_relative_{_hint}", lambda spark, sf, h=_hint: store.relative(mem(spark, sf), h, AS_OF).select(*COL), f"{MEM} SELECT {COLS} FROM memories WHERE substr(when_ts,1,10)::DATE BETWEEN DATE '2024-01-31' - {_a} AND DATE '2024-01-31' - {_b} ORDER BY when_ts DESC, memory_id LIMIT {_n}")


@query(f"{MEM} SELECT {COLS} FROM memories ORDER BY created_at DESC, memory_id LIMIT 25")
def recent(spark, sf):
    return store.newest(mem(spark, sf), F.lit(True), 25, "created_at").select(*COL)


@query(f"{MEM} SELECT memory_id, session_id, 'user' AS role, when_ts FROM memories WHERE session_id = 'chat_3'")
def session_history(spark, sf):
    role = F.coalesce(F.get_json_object("extra_json", "$.metadata.role"), F.lit("user"))
    return mem(spark, sf).where("session_id = 'chat_3'").select("memory_id", "session_id", role.alias("role"), "when_ts")


@query(f"{MEM} SELECT session_id, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS n FROM memories WHERE session_id LIKE 'chat_%' GROUP BY 1 ORDER BY last_at DESC, session_id LIMIT 50")
def chat_sessions(spark, sf):
    return store.sessions(mem(spark, sf))


_STATE = "s AS (SELECT memory_id, token_count, created_at FROM memories WHERE vec_id % 2 = 0), d AS (SELECT memory_id, token_count + 1 AS token_count, created_at FROM memories WHERE vec_id % 3 = 0)"


def _state(spark, sf):
    m = mem(spark, sf)
    cols = ["memory_id", "token_count", "created_at"]
    return m.where("vec_id % 2 = 0").select(*cols), m.where("vec_id % 3 = 0").withColumn("token_count", F.col("token_count") + 1).select(*cols)


@query(f"{MEM}, {_STATE} SELECT * FROM s WHERE memory_id NOT IN (SELECT memory_id FROM d) UNION ALL SELECT * FROM d")
def upsert(spark, sf):
    s, d = _state(spark, sf)
    return store.upsert(s, d.union(d))


@query(f"{MEM}, {_STATE} SELECT * FROM s UNION ALL SELECT * FROM d WHERE memory_id NOT IN (SELECT memory_id FROM s)")
def insert_ignore(spark, sf):
    return store.insert_ignore(*_state(spark, sf))


@query(f"{MEM}, {_STATE} SELECT * FROM s WHERE memory_id NOT IN (SELECT memory_id FROM d)")
def delete_rows(spark, sf):
    return store.delete(*_state(spark, sf))


@query(f"{MEM} SELECT memory_id, session_id FROM memories WHERE session_id <> 'chat_3'")
def delete_session(spark, sf):
    m = mem(spark, sf).select("memory_id", "session_id")
    return store.delete(m, m.where("session_id = 'chat_3'"))


@query(f"{MEM} SELECT memory_id, (accesses + CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 0 END)::BIGINT AS accesses, CASE WHEN vec_id % 4 = 0 THEN '2024-01-31' ELSE when_ts END AS last_access FROM memories")
def access_counts(spark, sf):
    m = mem(spark, sf)
    hit = m.where("vec_id % 4 = 0").select("memory_id", F.lit("2024-01-31").alias("at"))
    return store.record_access(m.select("memory_id", F.col("accesses").cast("long"), F.col("when_ts").alias("last_access")), hit.union(hit))


@query(f"{MEM} SELECT memory_id, who_type, who_id, where_value, when_ts, why, how FROM memories WHERE session_id = 'chat_1' AND (who_id ILIKE '%user%' OR who_type ILIKE '%user%')")
def export_rows(spark, sf):
    who = F.ilike("who_id", F.lit("%user%")) | F.ilike("who_type", F.lit("%user%"))
    return mem(spark, sf).where((F.col("session_id") == "chat_1") & who).orderBy(F.col("when_ts").desc(), "memory_id").select("memory_id", "who_type", "who_id", "where_value", "when_ts", "why", "how")


# ---- vectors -----------------------------------------------------------------------------------

_Q = "q AS (SELECT vec_id AS query_id, embedding AS query, 'notes from ' || where_value || ' yesterday' AS text, who_id AS actor, substr(when_ts,1,10) AS day FROM memories WHERE vec_id % 20 = 0)"
_DOT = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_SIM = f"sim AS (SELECT query_id, memory_id, {_DOT.format(a='m.embedding', b='q.query')} AS similarity FROM memories m CROSS JOIN q), near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS rank FROM sim)"


@query(f"{MEM}, {_Q}, {_SIM} SELECT query_id, memory_id, round(similarity, 6) AS similarity, rank FROM near WHERE rank <= 20")
def knn_topk(spark, sf):
    m = mem(spark, sf)
    return vector.knn(m, asked(m), 20).select("query_id", "memory_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"{MEM}, {_Q}, {_SIM} SELECT query_id, memory_id, round(least(1, greatest(0, (similarity + 1) / 2)), 6) AS semantic FROM near WHERE rank <= 50")
def knn_normalised(spark, sf):
    m = mem(spark, sf)
    return vector.knn(m, asked(m), 50).select("query_id", "memory_id", F.round(S.unit(F.col("similarity")), 6).alias("semantic"))


@query(f"{MEM}, n AS (SELECT memory_id, embedding, 3 * sqrt({_DOT.format(a='embedding', b='embedding')}) + 1e-8 AS norm FROM memories) SELECT memory_id, unnest(range(len(embedding))) AS i, round(unnest(embedding)::DOUBLE * 3 / norm, 6) AS x FROM n")
def l2_norm(spark, sf):
    v = S.normalised(F.transform("embedding", lambda x: x.cast("double") * 3))
    return mem(spark, sf).select("memory_id", F.posexplode(v).alias("i", "x")).select("memory_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query(f"{MEM} SELECT memory_id, embedding[1] AS first, embedding[64] AS last FROM (SELECT * FROM memories ORDER BY memory_id LIMIT 40) WHERE vec_id % 13 <> 0")
def all_vectors(spark, sf):
    m = mem(spark, sf).withColumn("embedding", F.when(F.col("vec_id") % 13 != 0, F.col("embedding")))
    return vector.vectors(m, 40).select("memory_id", F.element_at("embedding", 1).alias("first"), F.element_at("embedding", 64).alias("last"))


@query(f"{MEM}, {_Q}, {_SIM} SELECT query_id, n.memory_id, rank, round(similarity, 6) AS similarity, m.what, m.when_ts FROM near n LEFT JOIN (SELECT * FROM memories WHERE vec_id % 3 <> 0) m USING (memory_id) WHERE rank <= 10")
def raw_search(spark, sf):
    m = mem(spark, sf)
    got = vector.raw_search(m, m.where("vec_id % 3 <> 0"), asked(m), 10)
    return got.select("query_id", "memory_id", "rank", F.round("similarity", 6).alias("similarity"), "what", "when_ts")


@query(f"{MEM}, e AS (SELECT memory_id, CASE WHEN vec_id % 13 = 0 THEN 'missing' WHEN vec_id % 17 = 0 THEN 'zero' ELSE 'valid' END AS status FROM memories) SELECT status, count(*) AS n FROM e GROUP BY 1")
def embedding_audit(spark, sf):
    v = F.when(F.col("vec_id") % 13 == 0, None).when(F.col("vec_id") % 17 == 0, F.transform("embedding", lambda x: (x * 0).cast("float"))).otherwise(F.col("embedding"))
    return vector.audit(mem(spark, sf).withColumn("embedding", v)).groupBy("status").agg(F.count("*").alias("n"))


@query(f"{MEM} SELECT count(*) AS memories, count(*) FILTER (vec_id % 13 <> 0) AS embeddings, count(*) FILTER (vec_id % 13 <> 0 AND vec_id % 17 <> 0) AS indexed, count(*) FILTER (vec_id % 13 = 0) AS missing FROM memories")
def consistency(spark, sf):
    m = mem(spark, sf)
    return vector.consistency(m, m.where("vec_id % 13 <> 0"), m.where("vec_id % 13 <> 0 AND vec_id % 17 <> 0"))


# ---- scores ------------------------------------------------------------------------------------

_AGE = "(epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us({t}::TIMESTAMP)) / 3.6e9"
_REC = "CASE WHEN {w} IS NULL OR NOT regexp_matches({w}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}([T ]\\d{{2}}:\\d{{2}}.*)?$') THEN 0.5 ELSE least(1, greatest(0, pow(0.5, " + _AGE.format(t="try_cast({w} AS TIMESTAMP)") + " / 168.0))) END"
_WHEN1 = "(when_list::JSON ->> '$[0]')"
def _signals(on: str = "substr(m.when_ts,1,10) = q.day", cap: int = 500) -> str:
    return f"""top AS (SELECT query_id, memory_id, least(1, greatest(0, (similarity + 1) / 2)) AS semantic, 0.0 AS actor, 0.0 AS temporal FROM near WHERE rank <= 50),
act AS (SELECT query_id, memory_id, 0.0 AS semantic, 1.0 AS actor, 0.0 AS temporal FROM (SELECT q.query_id, m.memory_id, row_number() OVER (PARTITION BY q.query_id ORDER BY when_ts DESC, memory_id) AS n FROM memories m JOIN q ON m.who_id = q.actor) WHERE n <= 500),
tem AS (SELECT query_id, memory_id, 0.0 AS semantic, 0.0 AS actor, 1.0 AS temporal FROM (SELECT q.query_id, m.memory_id, row_number() OVER (PARTITION BY q.query_id ORDER BY when_ts DESC, memory_id) AS n FROM memories m JOIN q ON {on}) WHERE n <= {cap}),
cand AS (SELECT query_id, memory_id, max(semantic)::DOUBLE AS semantic, max(actor)::DOUBLE AS actor0, max(temporal)::DOUBLE AS temporal FROM (SELECT * FROM top UNION ALL SELECT * FROM act UNION ALL SELECT * FROM tem) GROUP BY 1, 2),
sig AS (SELECT c.query_id, m.*, c.semantic, c.temporal, {_REC.format(w=_WHEN1)} AS recency0,
  CASE WHEN c.actor0 > 0 OR coalesce((m.who_list::JSON ->> '$[0]') = q.actor, false) THEN 1.0 ELSE 0.0 END AS actor,
  CASE WHEN contains(lower(q.text), lower(m.where_value)) THEN 1.0 ELSE 0.0 END AS spatial, least(1, coalesce(accesses, 0) / 50.0) AS usage
  FROM cand c JOIN memories m USING (memory_id) JOIN q USING (query_id)),
one AS (SELECT *, recency0 * 0.1 AS recency FROM sig),
sco AS (SELECT *, 0.68 * semantic + 0.02 * recency + 0.10 * actor + 0.10 * temporal + 0.05 * spatial + 0.05 * usage AS score FROM one),
ran AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, memory_id) AS rank FROM sco)"""


#: Fixed values of the definition: 500 rows of an actor and of a date or range; relative words have their own number.
_FULL = f"{MEM}, {_Q}, {_SIM}, {_signals()}"


@query(f"{MEM} SELECT memory_id, round({_REC.format(w=_WHEN1)}, 6) AS from_list, round({_REC.format(w='when_ts')}, 6) AS from_ts FROM memories")
def recency(spark, sf):
    return mem(spark, sf).select("memory_id", F.round(S.recency(S.first_of(F.col("when_list")), AS_OF), 6).alias("from_list"), F.round(S.recency(F.col("when_ts"), AS_OF), 6).alias("from_ts"))


def _found(spark, sf, hint=None, **kw):
    m = mem(spark, sf)
    return R.search(m, asked(m, hint), AS_OF, **kw)


@query(f"{_FULL} SELECT query_id, memory_id, {', '.join(f'round({s}, 6) AS {s}' for s in R.SIGNALS)} FROM one")
def component_scores(spark, sf):
    m = mem(spark, sf)
    rows = R.signals(R.candidates(m, asked(m)), m, asked(m), AS_OF)
    return rows.withColumn("recency", F.col("recency") * 0.1).select("query_id", "memory_id", *[F.round(c, 6).alias(c) for c in R.SIGNALS])


@query(f"{_FULL} SELECT query_id, memory_id, rank, round(score, 6) AS score FROM ran WHERE rank <= 50")
def hybrid_search(spark, sf):
    return _found(spark, sf).select("query_id", "memory_id", "rank", F.round("score", 6).alias("score"))


_BETWEEN = "substr(m.when_ts,1,10)::DATE BETWEEN DATE '2024-01-31' - {a} AND DATE '2024-01-31' - {b}"
for _n, _phrase, _a, _b, _cap in (("hybrid_last_week", "last week", 7, 0, 300), ("hybrid_last_month", "past month", 30, 0, 500), ("hybrid_last_year", "last year", 365, 0, 1000), ("hybrid_yesterday", "yday", 1, 1, 200), ("hybrid_weeks_ago", "2 weeks ago", 14, 7, 500)):
    _sql = f"{MEM}, {_Q}, {_SIM}, {_signals(_BETWEEN.format(a=_a, b=_b), _cap)} SELECT query_id, memory_id, rank, round(temporal, 6) AS temporal, round(score, 6) AS score FROM ran WHERE rank <= 50"
    made(_n, lambda spark, sf, h=_phrase: _found(spark, sf, h).select("query_id", "memory_id", "rank", "temporal", F.round("score", 6).alias("score")), _sql)


@query(f"{_FULL}, re AS (SELECT query_id, memory_id, (0.3 * semantic + 0.4 * recency + 0.10 * actor + 0.10 * temporal + 0.05 * spatial + 0.05 * usage) AS score FROM ran WHERE rank <= 50) SELECT query_id, memory_id, round(score, 6) AS score FROM re")
def custom_weights(spark, sf):
    return _found(spark, sf, weights={"semantic": 0.3, "recency": 0.4}).select("query_id", "memory_id", F.round("score", 6).alias("score"))


@query()
def smart_recency_grouped(spark, sf):
    return _found(spark, sf, group=True).select("query_id", "memory_id", "group_id", F.round("recency", 6).alias("recency"), F.round("score", 6).alias("score"), "rank")


@query(f"{_FULL} SELECT query_id, rank, memory_id, round(score, 3) AS score, who_type || ': ' || who_id AS who, where_type || ': ' || where_value AS place, when_ts, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS label FROM ran WHERE rank <= 20")
def result_cards(spark, sf):
    return R.cards(_found(spark, sf).where("rank <= 20"))


@query(f"{_FULL} SELECT query_id, memory_id, who_id, where_value, why, how, coalesce((who_list::JSON ->> '$[0]'), '') AS first_actor, coalesce((when_list::JSON ->> '$[0]'), '') AS first_when, round(semantic, 6) AS semantic FROM ran WHERE rank <= 50")
def detail_rows(spark, sf):
    return _found(spark, sf).select("query_id", "memory_id", "who_id", "where_value", "why", "how", F.coalesce(S.first_of(F.col("who_list")), F.lit("")).alias("first_actor"), F.coalesce(S.first_of(F.col("when_list")), F.lit("")).alias("first_when"), F.round("semantic", 6).alias("semantic"))


@query(f"{_FULL} SELECT CASE WHEN score >= 0.9 THEN 9 ELSE greatest(0, floor(score * 10 + 1e-12))::INT END AS bin, count(*) AS n FROM ran WHERE rank <= 50 GROUP BY 1")
def score_histogram(spark, sf):
    return R.histogram(_found(spark, sf))


@query(f"{_FULL} SELECT {', '.join(f'round(avg({s}), 6) AS avg_{s}' for s in (*R.SIGNALS, 'score'))} FROM ran WHERE rank <= 50")
def component_avg(spark, sf):
    got = R.averages(_found(spark, sf))
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query(f"{MEM}, t AS (SELECT memory_id, when_ts, row_number() OVER (ORDER BY when_ts DESC, memory_id) AS n FROM memories WHERE substr(when_ts,1,10) = '2024-01-15') SELECT memory_id, when_ts, round(0.8 - 0.001 * (n - 1), 6) AS score FROM t WHERE n <= 200")
def temporal_rank(spark, sf):
    return R.temporal_rank(mem(spark, sf), "2024-01-15").withColumn("score", F.round("score", 6))


@query(f"{_FULL}, x AS (SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, memory_id) AS n FROM ran WHERE rank <= 50 AND memory_id NOT IN {ID3} AND score >= 0.4) SELECT query_id, memory_id, round(score, 6) AS score FROM x WHERE n <= 10")
def exclusion_threshold(spark, sf):
    ids = spark.createDataFrame([(x.strip("'"),) for x in ID3[1:-1].split(",")], "memory_id string")
    return R.narrowed(_found(spark, sf), ids, 0.4, 10).select("query_id", "memory_id", F.round("score", 6).alias("score"))


@query(f"""{MEM}, {_Q}, c AS (SELECT m.memory_id, {_DOT.format(a='m.embedding', b='q.query')} AS semantic, {_REC.format(w='when_ts')} AS recency, CASE WHEN who_id = actor THEN 1.0 ELSE 0.0 END AS actor, CASE WHEN substr(when_ts,1,10) = day THEN 1.0 ELSE 0.0 END AS temporal, CASE WHEN contains(lower(q.text), lower(where_value)) THEN 1.0 ELSE 0.0 END AS spatial, least(1, coalesce(accesses,0) / 50.0) AS usage FROM memories m CROSS JOIN q WHERE query_id = 20)
SELECT memory_id, {', '.join(f'round({s}, 6) AS {s}' for s in R.SIGNALS)}, round(.35 * semantic + .2 * recency + .15 * actor + .1 * temporal + .15 * usage, 6) AS total, CASE WHEN semantic > 0.7 THEN 'strong' WHEN semantic > 0.4 THEN 'moderate' ELSE 'weak' END AS verbal FROM c""")
def compare_memory(spark, sf):
    m = mem(spark, sf)
    got = R.compared(m, asked(m).where("query_id = 20"), AS_OF)
    return got.select("memory_id", *[F.round(c, 6).alias(c) for c in (*R.SIGNALS, "total")], "verbal")


# ---- packing -----------------------------------------------------------------------------------

_FOLD = """, it AS (SELECT query_id, memory_id, token_count, row_number() OVER (PARTITION BY query_id ORDER BY -score / greatest(1, token_count), memory_id) AS i FROM ran WHERE rank <= 50),
fold AS (SELECT query_id, memory_id, token_count, i, token_count <= {b} AS take, CASE WHEN token_count <= {b} THEN token_count ELSE 0 END AS used FROM it WHERE i = 1
  UNION ALL SELECT it.query_id, it.memory_id, it.token_count, it.i, f.used + it.token_count <= {b}, CASE WHEN f.used + it.token_count <= {b} THEN f.used + it.token_count ELSE f.used END FROM fold f JOIN it ON it.query_id = f.query_id AND it.i = f.i + 1)
SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY i) AS pick, token_count::BIGINT AS tokens, used::BIGINT AS used FROM fold WHERE take"""

for _n, _b in (("knapsack", 18432), ("knapsack_small", 512)):
    made(_n, lambda spark, sf, b=_b: B.knapsack(_found(spark, sf), b), _FULL.replace("WITH k AS", "WITH RECURSIVE k AS") + _FOLD.format(b=_b))


@query()
def block_chain(spark, sf):
    return B.chain(_found(spark, sf), 2048)


@query("SELECT conv_id, greatest(512, 18944 - sum(length(text) // 3))::BIGINT AS block_budget, greatest(512, 18944 - sum(length(text) // 3) - 512)::BIGINT AS search_budget FROM conversations GROUP BY 1")
def budget(spark, sf):
    over = fx.conversations(spark, sf).groupBy("conv_id").agg(F.sum(F.floor(F.length("text") / 3)).alias("o"))
    return over.select("conv_id", B.budget(F.col("o")).cast("long").alias("block_budget"), B.budget(F.col("o"), True).cast("long").alias("search_budget"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS fingerprint FROM documents")
def fingerprint(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", B.fingerprint(F.col("text")).alias("fingerprint"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5))::INT END AS tokens FROM documents")
def token_count(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", fx.tokens(F.col("text")).alias("tokens"))


# ---- analytics ---------------------------------------------------------------------------------


@query(f"{MEM} SELECT count(*) AS memories, count(DISTINCT session_id) AS sessions, count(DISTINCT who_id) AS actors, min(when_ts) AS first_ts, max(when_ts) AS last_ts, round(avg(token_count), 6) AS avg_tokens FROM memories")
def global_stats(spark, sf):
    return A.totals(mem(spark, sf)).withColumn("avg_tokens", F.round("avg_tokens", 6))


_DAY = "SELECT substr(when_ts,1,10)::DATE AS day, count(*) AS n, count(DISTINCT session_id) AS sessions, count(DISTINCT who_list) AS actors FROM memories GROUP BY 1"


@query(f"{MEM}, d AS ({_DAY}), g AS (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY))::DATE AS day) SELECT strftime(g.day, '%Y-%m-%d') AS day, coalesce(n, 0) AS n, coalesce(sessions, 0) AS sessions, coalesce(actors, 0) AS actors FROM g LEFT JOIN d USING (day)")
def timeline_daily(spark, sf):
    return A.filled(A.daily(mem(spark, sf))).withColumn("day", F.col("day").cast("string"))


@query(f"{MEM}, d AS ({_DAY}) SELECT strftime(day, '%Y-%m-%d') AS day, n, sessions, actors FROM d WHERE day > (SELECT max(day) FROM d) - 7")
def timeline_last_days(spark, sf):
    return A.daily(mem(spark, sf), 7).withColumn("day", F.col("day").cast("string"))


_LONG = "memories AS (SELECT o_orderdate::DATE::VARCHAR AS when_ts, o_custkey AS session_id, o_orderpriority AS who_list FROM orders)"


def _long(spark, sf):
    o = fx.table(spark, sf, "orders")
    return o.select(F.col("o_orderdate").cast("date").cast("string").alias("when_ts"), F.col("o_custkey").alias("session_id"), F.col("o_orderpriority").alias("who_list"))


for _n, _u in (("timeline_weekly", "week"), ("timeline_monthly", "month")):
    made(_n, lambda spark, sf, u=_u: A.rolled(A.daily(_long(spark, sf)), u).withColumn("period", F.col("period").cast("string")), f"WITH {_LONG}, d AS ({_DAY}) SELECT strftime(date_trunc('{_u}', day), '%Y-%m-%d') AS period, sum(n)::BIGINT AS n, count(DISTINCT sessions) AS sessions, count(DISTINCT actors) AS actors FROM d GROUP BY 1")
    made(_n + "_distinct", lambda spark, sf, u=_u: A.by_period(_long(spark, sf), u).withColumn("period", F.col("period").cast("string")), f"WITH {_LONG} SELECT strftime(date_trunc('{_u}', when_ts::DATE), '%Y-%m-%d') AS period, count(*) AS n, count(DISTINCT session_id) AS sessions, count(DISTINCT who_list) AS actors FROM memories GROUP BY 1")

_ITEM = {
    "who": ("who_list", "unnest(from_json(who_list, '[\"VARCHAR\"]'))", "who_list IS NOT NULL"),
    "when": ("when_list", "unnest(from_json(when_list, '[\"VARCHAR\"]'))", "when_list IS NOT NULL"),
    "where": ("where_list", "unnest(from_json(where_list, '[\"VARCHAR\"]'))", "where_list IS NOT NULL"),
    "why": ("why", "unnest([substr(x, 1, 30) for x in list_transform(regexp_split_to_array(why, '[;,.]'), lambda p: trim(p)) if length(x) > 10][1:3])", "why IS NOT NULL"),
    "how": ("how", "unnest([substr(x, 1, 30) for x in list_transform(regexp_split_to_array(how || ' and by hand', '[;,.]'), lambda p: trim(p)) if length(x) > 10][1:3])", "how IS NOT NULL"),
}


def _items(spark, sf, component):
    m = mem(spark, sf)
    if component == "how":
        m = m.withColumn("how", F.concat("how", F.lit(" and by hand")))
    return A.items(m, component)


def _item_sql(component):
    _, expr, ok = _ITEM[component]
    return f"{MEM}, l AS (SELECT * FROM memories WHERE {ok} ORDER BY created_at DESC, memory_id LIMIT 1000), i0 AS (SELECT memory_id, created_at, {expr} AS item, generate_subscripts({expr.removeprefix('unnest(')[:-1]}, 1) AS spot FROM l), i AS (SELECT * FROM i0 WHERE item <> '')"


_COOC = """, met AS (SELECT item, min((-epoch(created_at::TIMESTAMP), memory_id, spot)) AS met FROM i GROUP BY 1), r AS (SELECT item, row_number() OVER (ORDER BY met) AS r FROM met),
o AS (SELECT DISTINCT memory_id, item, r FROM i JOIN r USING (item)), p AS (SELECT a.item AS source, b.item AS target, count(*) AS weight, a.r AS ra, b.r AS rb FROM o a JOIN o b USING (memory_id) WHERE a.r <= 50 AND b.r > a.r AND b.r <= a.r + 19 GROUP BY 1, 2, 4, 5 ORDER BY ra, rb LIMIT 100)
SELECT source, target, weight FROM p"""
# entities of plain texts are found by patterns that differ in SQL on other letters than ASCII: those of what are tested against a plain model
for _c in A.COMPONENTS:
    made(f"network_{_c}", lambda spark, sf, c=_c: A.frequency(_items(spark, sf, c)), None if _c == "what" else f"{_item_sql(_c)} SELECT item, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, item LIMIT 50")
made("entity_cooccur", lambda spark, sf: A.cooccurrence(_items(spark, sf, "what")))
made("network_when_cooccur", lambda spark, sf: A.cooccurrence(_items(spark, sf, "when")), _item_sql("when") + _COOC)
made("entity_cloud", lambda spark, sf: A.cloud(_items(spark, sf, "what")).withColumn("size", F.round("size", 6)))
made("place_cloud", lambda spark, sf: A.cloud(_items(spark, sf, "where")).withColumn("size", F.round("size", 6)), f"{_item_sql('where')}, t AS (SELECT item, count(*) AS n FROM i GROUP BY 1 ORDER BY n DESC, item LIMIT 20) SELECT item, n, round(least(2.0, 0.8 + 1.2 * n / (SELECT max(n) FROM t)), 6) AS size FROM t")


@query(f"{MEM} SELECT who_list, count(*) AS n FROM memories WHERE who_list IS NOT NULL GROUP BY 1 ORDER BY n DESC, who_list LIMIT 10")
def top_actors(spark, sf):
    return A.top_actors(mem(spark, sf))


@query("SELECT conv_id, turn, role, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS total, substr(lag(text) OVER w, 1, 100) AS before, substr(lead(text) OVER w, 1, 100) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next_context(spark, sf):
    return A.turns(fx.conversations(spark, sf))


@query("WITH p AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations) SELECT conv_id, count(*) FILTER (role = 'user' AND nx = 'assistant') AS answers, count(*) FILTER (role = nx AND NOT (role = 'user' AND nx = 'assistant')) AS same_role FROM p GROUP BY 1")
def qa_relationships(spark, sf):
    return A.relations(fx.conversations(spark, sf))


@query("SELECT count(*) AS documents, sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> '')))::BIGINT AS words, sum(length(text))::BIGINT AS chars, count(*) FILTER (length(text) > 0) AS ok FROM documents")
def doc_totals(spark, sf):
    return A.document_totals(fx.table(spark, sf, "documents"))


@query("SELECT sum((upper(event_type) LIKE '%ERROR%')::INT)::BIGINT AS n_error, sum((upper(event_type) LIKE '%WARNING%')::INT)::BIGINT AS n_warning, sum((upper(event_type) LIKE '%INFO%')::INT)::BIGINT AS n_info, sum((upper(event_type) LIKE '%DEBUG%')::INT)::BIGINT AS n_debug FROM events")
def log_levels(spark, sf):
    return fx.table(spark, sf, "events").agg(*X.log_levels(F.col("event_type")))


# ---- conversations, texts, dates -----------------------------------------------------------------


@query(C.MEMORIES_SQL)
def conv_to_memories(spark, sf):
    return C.memories(fx.conversations(spark, sf))


_ASCII = "regexp_full_match(text, '[\\x00-\\x7F]*')"


@query()
def entities_regex(spark, sf):
    d = fx.table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(X.entities(F.col("text")), "|").alias("entities"), F.array_join(X.rule_entities(F.col("text")), "|").alias("by_rule"))


_VALUES = "t AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations)"


def _messages(spark, sf):
    return fx.conversations(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def _case(rules):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules)


def _any(words, col="lower(text)"):
    return "(" + " OR ".join("contains({}, '{}')".format(col, w) for w in words) + ")"


_RECALL = _case([(f"contains(lower(text), '{k}')", f"'memory_recall: ' || substr(trim(substr(text, instr(lower(text), '{k}') + {len(k)})), 1, 50)") for k in X.RECALL]) + " END"


@query(f"WITH {_VALUES} SELECT id, {_RECALL} AS why FROM t")
def recall_topic(spark, sf):
    return _messages(spark, sf).select("id", X.recall_topic(F.col("text")).alias("why"))


_TYPE = _case([(_any(w), _case([(_any(s) if s else "true", f"'{n}'") for s, n in cases]) + " END") for w, cases in X.QUERY_RULES]) + " ELSE 'default' END"


@query(f"WITH {_VALUES} SELECT id, {_TYPE} AS kind, CASE WHEN {_any(X.SEARCH_TRIGGERS)} THEN 'web_search' END AS tool FROM t")
def query_type(spark, sf):
    return _messages(spark, sf).select("id", X.query_type(F.col("text")).alias("kind"), X.wants_search(F.col("text")).alias("tool"))


_HOURS = "h AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in X.VALID_HOURS.items()) + ") v(kind, hours))"


@query(f"{MEM}, {_VALUES}, {_HOURS}, y AS (SELECT id, {_TYPE} AS kind FROM t), v AS (SELECT kind, count(*) FILTER ({_AGE.format(t='when_ts')} <= hours) AS valid, count(*) FILTER (NOT {_AGE.format(t='when_ts')} <= hours) AS invalid FROM h CROSS JOIN memories GROUP BY kind) SELECT id, kind, valid, invalid, valid = 0 AND kind IN {X.TIME_SENSITIVE} AS needs_tool FROM y JOIN v USING (kind)")
def freshness(spark, sf):
    return S.fresh_for(_messages(spark, sf).select("id", X.query_type(F.col("text")).alias("kind")), mem(spark, sf), AS_OF)


@query(f"WITH {_VALUES}, j AS (SELECT id, nullif(regexp_extract(text, '(?s)\\{{.*\\}}'), '') AS o FROM t) SELECT id, (CASE WHEN json_valid(o) THEN o::JSON ->> '$.a' END) AS a FROM j")
def json_salvage(spark, sf):
    return _messages(spark, sf).select("id", X.first_json(F.col("text"), "struct<a:string>")["a"].alias("a"))


@query()
def tool_calls(spark, sf):
    return fx.conversations(spark, sf).select("conv_id", "turn", F.array_join(F.transform(X.tool_calls(F.col("text")), lambda c: c["name"]), ",").alias("calls"), X.without_tool_calls(F.col("text")).alias("rest"))


_N = "try_cast(regexp_extract(lower(text), '(\\d+)\\s+(day|week|month|year)s?\\s+ago', 1) AS INT)"
_U = "regexp_extract(lower(text), '(\\d+)\\s+(day|week|month|year)s?\\s+ago', 2)"
_D = "DATE '2024-01-31'"
_ISO = "regexp_extract(text, '\\d{4}-\\d{2}-\\d{2}')"
_HINT = [(_any(("yesterday", "yday")), "['relative', 'yesterday', '', '']"), (_any(("today", "now", "current")), "['relative', 'today', '', '']")]
_HINT += [(_any((f"last {u}", f"past {u}")), f"['relative', 'last_{u}', '', '']") for u in ("week", "month", "year")]
_HINT += [(f"{_U} = 'day'", f"['date', '', ({_D} - {_N})::VARCHAR, ({_D} - {_N})::VARCHAR]")]
_HINT += [(f"{_U} = '{u}'", f"['range', '', ({_D} - {_N} * {d})::VARCHAR, ({_D} - ({_N} - 1) * {d})::VARCHAR]") for u, d in (("week", 7), ("month", 30))]
_HINT += [(f"{_ISO} <> ''", f"['date', '', {_ISO}, {_ISO}]")]


@query(f"WITH {_VALUES}, h AS (SELECT id, {_case(_HINT)} END AS h FROM t) SELECT id, h[1] AS kind, nullif(h[2], '') AS value, nullif(h[3], '') AS first, nullif(h[4], '') AS last FROM h")
def temporal_rule(spark, sf):
    return _messages(spark, sf).select("id", temporal.hint(F.col("text"), AS_OF).alias("h")).select("id", "h.kind", "h.value", "h.first", "h.last")


_CLEAN = "text"
for _p in temporal.PHRASES:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', '', 'gi')"


@query(f"WITH {_VALUES}, c AS (SELECT id, text, trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')) AS c FROM t) SELECT id, CASE WHEN length(c) < 10 THEN text ELSE c END AS cleaned FROM c")
def temporal_clean(spark, sf):
    return _messages(spark, sf).select("id", temporal.cleaned(F.col("text")).alias("cleaned"))


@query(f"{MEM} SELECT memory_id, 'WHAT: ' || what || '\nWHY: ' || why || '\nHOW: ' || how || '\nRAW: ' || raw_text AS embed_text, 'WHAT: ' || what || '\nWHY: ' || why || '\nHOW: ' || coalesce(who_label, 'None') AS part_text FROM memories")
def embed_text(spark, sf):
    return mem(spark, sf).select("memory_id", X.embed_text(F.col("what"), F.col("why"), F.col("how"), F.col("raw_text")).alias("embed_text"), X.embed_text(F.col("what"), F.col("why"), F.col("who_label")).alias("part_text"))


_CODE = "t AS (SELECT doc_id, text FROM documents)"


@query(f"WITH {_CODE}, l AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c]') AS l FROM t) SELECT doc_id, array_to_string([trim(x) for x in l if regexp_matches(x, '^(import|from|const|let|var|require)')][1:10], '|') AS imports, array_to_string([trim(x) for x in l if regexp_matches(x, '^(def |function |func |fn |sub )')][1:10], '|') AS functions, array_to_string([trim(x) for x in l if regexp_matches(x, '^(class |interface |struct |enum )')][1:10], '|') AS classes FROM l")
def code_outline(spark, sf):
    o = X.code_outline(F.col("text"))
    return fx.table(spark, sf, "documents").select("doc_id", *[F.array_join(o[c], "|").alias(c) for c in ("imports", "functions", "classes")])


@query("SELECT page_id, regexp_replace(html, '<[^<]+?>', '', 'g') AS text, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title FROM pages")
def html_strip(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("text"), X.html_title(F.col("html")).alias("title"))


for _n, _k in (("sentence", chunks.Sentences), ("paragraph", chunks.Paragraphs), ("semantic", chunks.Sections)):
    made(f"chunk_{_n}", lambda spark, sf, k=_k: chunks.chunked(fx.table(spark, sf, "documents"), k()))

# ---- graphs and clusters -------------------------------------------------------------------------

_ACT = "a AS (SELECT DISTINCT session_id || substr(when_ts,1,10) AS act, memory_id FROM memories), pr AS (SELECT x.memory_id AS m1, y.memory_id AS m2, count(*) AS n FROM a x JOIN a y ON x.act = y.act AND x.memory_id < y.memory_id GROUP BY 1, 2)"
_SYN = f"{_ACT}, s0 AS (SELECT m1, m2, least(1.0, 0.05 * (1 + (hash_a + hash_b) % 20)) AS weight FROM (SELECT m1, m2, substr(m1, 5)::BIGINT AS hash_a, substr(m2, 5)::BIGINT AS hash_b FROM pr))"


def _acts(m):
    return m.select(F.concat("session_id", F.substring("when_ts", 1, 10)).alias("act"), "memory_id")


def _syn(m):
    n = F.substring("m1", 5, 12).cast("long") + F.substring("m2", 5, 12).cast("long")
    return G.all_pairs(_acts(m), "act").select("m1", "m2", F.least(F.lit(1.0), 0.05 * (1 + n % 20)).alias("weight"))


@query(f"{MEM}, {_ACT} SELECT m1, m2, n FROM pr")
def cooccurrence(spark, sf):
    return G.all_pairs(_acts(mem(spark, sf)), "act")


@query(f"{MEM}, {_SYN} SELECT m1, m2, round(least(1.0, weight + 0.01 * n), 6) AS weight FROM s0 JOIN pr USING (m1, m2)")
def hebbian(spark, sf):
    m = mem(spark, sf)
    return G.hebbian(_syn(m), _acts(m), "act", known=G.many_pairs(_acts(m), "act")).withColumn("weight", F.round("weight", 6))


@query(f"{MEM}, {_SYN}, w AS (SELECT m1, m2, weight * 0.1 * (1 - 0.001) AS weight FROM s0) SELECT m1, m2, round(weight, 6) AS weight FROM w WHERE weight >= 0.01")
def decay(spark, sf):
    return G.decay(_syn(mem(spark, sf)).withColumn("weight", F.col("weight") * 0.1)).withColumn("weight", F.round("weight", 6))


_IMP = "ends AS (SELECT m1 AS memory_id, weight FROM s0 UNION ALL SELECT m2, weight FROM s0), im AS (SELECT memory_id, avg(weight) * sqrt(count(*)) AS importance, count(*) AS connections FROM ends GROUP BY 1), al AS (SELECT memory_id, coalesce(importance, 0) AS importance, coalesce(connections, 0) AS connections FROM memories LEFT JOIN im USING (memory_id))"


@query(f"{MEM}, {_SYN}, {_IMP} SELECT memory_id, round(importance, 6) AS importance, connections FROM al")
def importance(spark, sf):
    m = mem(spark, sf)
    return G.importance(m, _syn(m)).withColumn("importance", F.round("importance", 6))


@query(f"{MEM}, {_SYN}, {_IMP} SELECT memory_id, round(importance, 6) AS importance, row_number() OVER (ORDER BY round(importance, 6) DESC, memory_id) <= 100 AS keep FROM al")
def keep_forget(spark, sf):
    m = mem(spark, sf)
    return G.keep_or_forget(G.importance(m, _syn(m)).withColumn("importance", F.round("importance", 6)), 100)


@query(f"{MEM}, {_SYN}, x AS (SELECT min(m1) AS m FROM s0) SELECT m2 AS memory_id, round(weight, 6) AS weight FROM s0, x WHERE m1 = m AND weight >= 0.1 UNION SELECT m1, round(weight, 6) FROM s0, x WHERE m2 = m AND weight >= 0.1")
def related(spark, sf):
    s = _syn(mem(spark, sf))
    return G.related(s, s.agg(F.min("m1")).first()[0]).withColumn("weight", F.round("weight", 6))


_COS = f"{_DOT.format(a='x.embedding', b='y.embedding')} / (sqrt({_DOT.format(a='x.embedding', b='x.embedding')}) * sqrt({_DOT.format(a='y.embedding', b='y.embedding')}))"
_AFF = f"{_ACT}, pb AS (SELECT m1, m2, n FROM pr UNION ALL SELECT m2, m1, n FROM pr), sm AS (SELECT * FROM memories WHERE vec_id % 20 = 0), af AS (SELECT x.memory_id AS m1, y.memory_id AS m2, 0.4 * least(1.0, coalesce(pb.n, 0) / 10.0) + 0.3 * exp(-abs(epoch(x.when_ts::TIMESTAMP) - epoch(y.when_ts::TIMESTAMP)) / 86400.0) + 0.3 * ({_COS} + 1) / 2 AS affinity FROM sm x JOIN memories y ON x.memory_id <> y.memory_id LEFT JOIN pb ON pb.m1 = x.memory_id AND pb.m2 = y.memory_id)"
_CL = "cl AS (SELECT memory_id, vec_id % 4 AS cluster, vec_id % 20 = 0 AS asked FROM memories), en AS (SELECT * FROM (VALUES (0, 0.9), (1, 0.2), (2, 0.5)) v(cluster, energy))"
_PULL = "pu AS (SELECT af.m1 AS memory_id, t.cluster, avg(affinity) * any_value(coalesce(energy, 0.5)) AS pull FROM af JOIN cl t ON t.memory_id = af.m2 JOIN cl o ON o.memory_id = af.m1 LEFT JOIN en ON en.cluster = t.cluster WHERE t.cluster <> o.cluster GROUP BY 1, 2)"


def _affine(m):
    """What affinities of the query set's memories to all others are made of: vectors, last accesses, shared accesses."""
    return m.select("memory_id", "embedding"), m.select("memory_id", F.to_timestamp("when_ts").alias("last_access")), G.all_pairs(_acts(m), "act", asked=_set(m))


def _set(m):
    return m.where(F.col("vec_id") % QUERY_STEP == 0).select("memory_id")


def _clusters(m):
    return m.select("memory_id", (F.col("vec_id") % 4).alias("cluster"))


def _energy(spark):
    return spark.createDataFrame([(0, 0.9), (1, 0.2), (2, 0.5)], "cluster long, energy double")


@query(f"{MEM}, {_AFF} SELECT m1, m2, round(affinity, 6) AS affinity FROM af")
def affinity(spark, sf):
    m = mem(spark, sf)
    v, last, co = _affine(m)
    return G.affinity(v, co, last, _set(m)).withColumn("affinity", F.round("affinity", 6))


@query(f"{MEM}, {_AFF}, {_CL}, {_PULL} SELECT memory_id, cluster, round(pull, 6) AS pull FROM pu")
def cluster_pull(spark, sf):
    m = mem(spark, sf)
    return liquid.pulls(*_affine(m), _clusters(m), _energy(spark), _set(m)).withColumn("pull", F.round("pull", 6))


@query(f"{MEM}, {_AFF}, {_CL}, {_PULL}, b AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY pull DESC, cluster) AS n FROM pu) SELECT cl.memory_id, CASE WHEN b.pull > 0.1 THEN b.cluster ELSE cl.cluster END AS cluster, coalesce(b.pull > 0.1, false) AS moved FROM cl LEFT JOIN b ON b.memory_id = cl.memory_id AND n = 1 WHERE asked")
def flow_step(spark, sf):
    m = mem(spark, sf)
    c = _clusters(m)
    return G.flow(c.join(_set(m), "memory_id", "left_semi"), liquid.pulls(*_affine(m), c, _energy(spark), _set(m)))


@query()
def merge_clusters(spark, sf):
    m = mem(spark, sf)
    return liquid.merged(m.select("memory_id", "embedding"), m.select("memory_id", (F.col("vec_id") % 4).alias("cluster")), _energy(spark), 0.2)


#: Clusters over which the query set is spread, so that the first one, which has the most energy, pulls the others' memories.
_CL2 = _CL.replace("vec_id % 4", "(vec_id // 20) % 4")


@query(f"{MEM}, {_AFF}, {_CL2}, {_PULL}, b AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY pull DESC, cluster) AS n FROM pu) SELECT cl.memory_id, cl.cluster AS before, CASE WHEN b.pull > 0.1 THEN b.cluster ELSE cl.cluster END AS cluster, coalesce(b.pull > 0.1, false) AS moved, round(b.pull, 6) AS pull FROM cl LEFT JOIN b ON b.memory_id = cl.memory_id AND n = 1 WHERE asked")
def flow_round(spark, sf):
    """One round of the loop: the query set's memories and where they go."""
    m = mem(spark, sf)
    c = _spread(m)
    p = liquid.pulls(*_affine(m), c, _energy(spark), _set(m))
    best = p.groupBy("memory_id").agg(F.round(F.max("pull"), 6).alias("pull"))
    own = c.join(_set(m), "memory_id", "left_semi")
    return G.flow(own, p).join(own.withColumnRenamed("cluster", "before"), "memory_id").join(best, "memory_id", "left")


def _spread(m):
    return m.select("memory_id", F.expr("(vec_id div 20) % 4").alias("cluster"))


@query()
def flow_settled(spark, sf):
    """The clusters when nothing moves any more, with the query set flowing and its accesses giving energy."""
    m = mem(spark, sf)
    v, last, co = _affine(m)
    now, force, _ = liquid.settled(v, last, liquid.written(co, "pairs"), _spread(m), _energy(spark), _set(m), _set(m))
    return now.join(force, "cluster", "left").select("memory_id", "cluster", F.round("energy", 6).alias("energy"))


@query(f"""{MEM}, v AS (SELECT memory_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM memories), c AS (SELECT memory_id AS c, x AS cx, row_number() OVER (ORDER BY memory_id) - 1 AS cluster FROM v ORDER BY memory_id LIMIT 8),
d AS (SELECT v.memory_id, cluster, list_inner_product(cx, cx) - 2 * list_inner_product(x, cx) AS d FROM v, c), a AS (SELECT memory_id, arg_min(cluster, (d, cluster)) AS cluster FROM d GROUP BY 1)
SELECT cluster::INTEGER AS cluster, i::INTEGER AS i, count(*) AS n, round(avg(x[i + 1]), 6) AS x FROM a JOIN v USING (memory_id), range(64) t(i) GROUP BY 1, 2""")
def kmeans_step(spark, sf):
    """The centroids after one batch, all memories, which starts from the first eight memories' vectors."""
    m = mem(spark, sf).select("memory_id", "embedding")
    first = m.orderBy("memory_id").limit(8).withColumn("cluster", (F.row_number().over(Window.orderBy("memory_id")) - 1).cast("int"))
    start = first.select("cluster", F.transform("embedding", lambda x: x.cast("double")).alias("centroid"), F.lit(0).cast("long").alias("n"))
    now = minibatch.moved(start, minibatch.sums(m, start)).where("n > 0")
    return now.select("cluster", F.posexplode("centroid").alias("i", "x"), "n").select("cluster", "i", "n", F.round("x", 6).alias("x"))


@query()
def kmeans(spark, sf):
    return G.kmeans(mem(spark, sf).select("memory_id", "embedding"), 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"{MEM}, {_CL}, h AS (SELECT cluster, count(*) AS n FROM cl WHERE substr(memory_id, 5)::BIGINT % 3 = 0 GROUP BY 1) SELECT cluster, round(least(1.0, coalesce(energy, 0.5) + 0.05 * coalesce(n, 0)) * 0.99, 6) AS energy FROM en FULL JOIN h USING (cluster)")
def energy(spark, sf):
    m = mem(spark, sf)
    c = _clusters(m)
    return G.cluster_energy(_energy(spark), c, m.where("vec_id % 3 = 0").select("memory_id")).withColumn("energy", F.round("energy", 6))


@query(f"{MEM}, x AS (SELECT 'g' || (vec_id // 10) AS memory_id, vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM memories), c AS (SELECT memory_id, i, list(x ORDER BY vec_id) AS xs FROM x GROUP BY 1, 2), d AS (SELECT memory_id, i, xs[1] AS base, list_reduce(xs, lambda a, x: a * 0.95 + x * 0.05) AS drift FROM c) SELECT memory_id, i, round(drift, 6) AS drift, round(0.7 * base + 0.3 * drift, 6) AS moved FROM d")
def drift(spark, sf):
    m = mem(spark, sf).select(F.concat(F.lit("g"), F.floor(F.col("vec_id") / 10)).alias("memory_id"), F.col("vec_id").alias("at"), F.col("embedding").alias("context"))
    d = G.drift(m)
    base = m.groupBy("memory_id").agg(F.min_by("context", "at").alias("embedding"))
    both = G.drifted(base, d).join(d, "memory_id").select("memory_id", F.posexplode(F.arrays_zip("drift", "embedding")).alias("i", "x"))
    return both.select("memory_id", F.col("i").cast("long").alias("i"), F.round("x.drift", 6).alias("drift"), F.round("x.embedding", 6).alias("moved"))


@query(f"{MEM}, {_SYN}, o AS (SELECT m1, m2, weight FROM s0 WHERE weight > 0.52), n AS (SELECT m1, m2, 2 * weight AS w FROM s0 WHERE weight > 0.32) SELECT m1, m2, round(CASE WHEN weight IS NULL THEN w ELSE least(1.0, weight + coalesce(w, 0)) END, 6) AS weight FROM o FULL JOIN n USING (m1, m2)")
def synapse_upsert(spark, sf):
    m = mem(spark, sf)
    s = _syn(m)
    more = s.where("weight > 0.32").select(F.col("m2").alias("m1"), F.col("m1").alias("m2"), (2 * F.col("weight")).alias("weight"))
    return G.stored(s.where("weight > 0.52"), more, G.many_pairs(_acts(m), "act")).withColumn("weight", F.round("weight", 6))


@query(f"{MEM} SELECT memory_id, when_ts AS at FROM memories WHERE when_ts::TIMESTAMP > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
def access_window(spark, sf):
    return G.recent_access(mem(spark, sf).select("memory_id", F.col("when_ts").alias("at")), AS_OF)


@query(f"{MEM}, {_CL} SELECT cluster, count(*) AS members, coalesce(any_value(energy), 0.5)::DOUBLE AS energy FROM cl LEFT JOIN en USING (cluster) GROUP BY 1")
def cluster_summary(spark, sf):
    return G.cluster_summary(_clusters(mem(spark, sf)), _energy(spark))


@query("SELECT count(*) AS batches, sum(r)::BIGINT AS records, sum(m)::BIGINT AS memories, round(sum(r) / sum(s), 6) AS records_per_s, round(sum(m) / sum(s), 6) AS memories_per_s, round(100.0 * (sum(r) - sum(f)) / sum(r), 6) AS success_pct, round(avg(s), 6) AS avg_batch_s, max(s) AS max_batch_s FROM (SELECT event_id // 100 AS b, count(*) AS r, count(*) FILTER (event_type <> 'error') AS m, count(*) FILTER (event_type = 'error') AS f, 1.0 + (event_id // 100) % 5 AS s FROM events GROUP BY event_id // 100)")
def import_stats(spark, sf):
    from tessera.sources import jobs

    e = fx.table(spark, sf, "events").withColumn("b", F.floor(F.col("event_id") / 100))
    bad = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0))
    rows = e.groupBy("b").agg(F.count("*").alias("records"), (F.count("*") - bad).alias("memories"), bad.alias("failed")).withColumn("seconds", 1.0 + F.col("b") % 5)
    got = jobs.throughput(rows)
    return got.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in got.dtypes])


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 1 THEN lang END, ''), source) AS content, CASE doc_id % 4 WHEN 1 THEN 'llm_message' WHEN 2 THEN 'system' ELSE 'user_message' END AS event_type,
  CASE doc_id % 4 WHEN 1 THEN 'llm:' WHEN 2 THEN 'system:' ELSE 'user:' END || source AS actor, false AS is_memory, length(coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END, ''), nullif(CASE WHEN doc_id % 3 = 1 THEN lang END, ''), source)) > 500 AS is_long FROM documents""")
def record_dispatch(spark, sf):
    from tessera.sources import readers

    d = fx.table(spark, sf, "documents")
    kind = F.when(F.col("doc_id") % 4 == 1, "llm").when(F.col("doc_id") % 4 == 2, "system")
    rows = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise("").alias("raw_text"), F.when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("text"), F.col("source").alias("content"), kind.alias("who_type"), F.col("source").alias("who_id"))
    return rows.select("doc_id", *[c.alias(n) for n, c in readers.dispatch_columns(rows).items()])


@query("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN '[Part ' || (doc_id % 3) || ' of ' || (1 + doc_id % 3) || '] ' ELSE '' END || text || CASE WHEN doc_id % 2 = 0 THEN '\n[Source: ' || source || ']' ELSE '' END AS memory_text FROM documents")
def part_text(spark, sf):
    d = fx.table(spark, sf, "documents")
    part = F.col("doc_id") % 3
    return d.select("doc_id", X.part_text(F.col("text"), part, part + 1, F.when(F.col("doc_id") % 2 == 0, F.col("source"))).alias("memory_text"))


@query("SELECT DISTINCT event_type, CASE WHEN event_type IN ('tool_call', 'tool_result') THEN 'tool' WHEN event_type = 'user_message' THEN 'user' WHEN event_type = 'llm_message' THEN 'llm' ELSE 'system' END AS who_type FROM (SELECT event_type FROM events UNION ALL SELECT unnest(['tool_call', 'tool_result', 'user_message', 'llm_message', 'system']))")
def who_types(spark, sf):
    own = spark.createDataFrame([(x,) for x in ("tool_call", "tool_result", "user_message", "llm_message", "system")], "event_type string")
    return fx.table(spark, sf, "events").select("event_type").union(own).distinct().select("event_type", X.who_type(F.col("event_type")).alias("who_type"))


@query("SELECT event_id, 'mem_' || substr(md5(event_id::VARCHAR), 1, 12) AS memory_id FROM events")
def stable_ids(spark, sf):
    return fx.table(spark, sf, "events").select("event_id", F.concat(F.lit("mem_"), F.substring(F.md5(F.col("event_id").cast("string")), 1, 12)).alias("memory_id"))


@query(f"{MEM} SELECT memory_id, round({_REC.format(w='when_ts')}, 6) AS score FROM memories WHERE where_value = 'src3' ORDER BY when_ts DESC, memory_id LIMIT 100")
def place_candidates(spark, sf):
    from tessera.operators import legacy

    return legacy.hinted(mem(spark, sf), AS_OF, place="src3").withColumn("score", F.round("score", 6))


@query(f"{_FULL} SELECT query_id, memory_id, round(least(1.0, (semantic + 0.1 * (actor > 0)::INT + 0.1 * (temporal > 0)::INT + 0.05 * least(1, coalesce(accesses, 0) / 100.0)) * CASE WHEN query_id = 20 THEN 1.5 ELSE 1.0 END), 6) AS score FROM one")
def additive_rerank(spark, sf):
    from tessera.operators import legacy

    m = mem(spark, sf)
    rows = R.signals(R.candidates(m, asked(m)), m, asked(m), AS_OF, usage=m.select("memory_id", "accesses"))
    return legacy.additive(rows, F.col("query_id") == 20).select("query_id", "memory_id", F.round("score", 6).alias("score"))


@query(f"{MEM} SELECT memory_id, '- ' || what || ' (' || substr(coalesce(why, ''), 1, 100) || ')' AS line FROM memories ORDER BY when_ts DESC, memory_id LIMIT 10")
def context_lines(spark, sf):
    top = store.newest(mem(spark, sf), F.lit(True), 10)
    return top.select("memory_id", F.concat(F.lit("- "), F.col("what"), F.lit(" ("), F.substring(F.coalesce("why", F.lit("")), 1, 100), F.lit(")")).alias("line"))


for _n, _desc in (("who_id", False), ("token_count", True), ("where_value", False), ("created_at", True), ("why", False), ("how", True), ("memory_id", False), ("accesses", True), ("where_type", False)):
    made(f"sorted_by_{_n}", lambda spark, sf, n=_n, d=_desc: store.page(mem(spark, sf).select(*{*COL, "created_at", n}), n, d, 1, 30).select(*COL), f"{MEM} SELECT {COLS} FROM memories ORDER BY {_n} {'DESC NULLS LAST' if _desc else 'ASC NULLS FIRST'}, memory_id LIMIT 30")


@query(f"{MEM}, s AS (SELECT session_id, substr(when_ts,1,10)::DATE AS day, count(*) AS n FROM memories GROUP BY 1, 2) SELECT session_id, max(n) AS busiest, count(*) AS days FROM s GROUP BY 1")
def session_days(spark, sf):
    rows = mem(spark, sf).groupBy("session_id", F.to_date(F.substring("when_ts", 1, 10)).alias("day")).agg(F.count("*").alias("n"))
    return rows.groupBy("session_id").agg(F.max("n").alias("busiest"), F.count("*").alias("days"))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def stream_timeline(spark, sf):
    """The timeline as a stream over the event files, run until it has seen them all; its final windows are a table in memory."""
    import uuid

    name = f"timeline_{uuid.uuid4().hex}"
    schema = fx.table(spark, sf, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = rows.select(F.col("ts").cast("timestamp").alias("timestamp"), "event_type").withWatermark("timestamp", "1 day")
    days = rows.groupBy(F.window("timestamp", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("errors"))
    days.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination(600)
    return spark.table(name).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "errors")


@query("SELECT event_id AS id, event_type AS key, (value - 1)::DECIMAL(18,2)::VARCHAR AS old_value, value::DECIMAL(18,2)::VARCHAR AS new_value, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS changed_at FROM events WHERE event_type = 'click' ORDER BY changed_at DESC, id DESC LIMIT 50")
def config_history(spark, sf):
    from tessera.plans import config

    value = F.col("value").cast("decimal(18,2)")
    rows = fx.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), (F.col("value") - 1).cast("decimal(18,2)").cast("string").alias("old_value"), value.cast("string").alias("new_value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("changed_at"))
    return config.history(rows, "click")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid search with grouping, packed into a budget, as result cards."""
    m = mem(spark, sf)
    found = R.search(m, asked(m), AS_OF, group=True)
    return R.cards(found.join(B.knapsack(found, 18432), ["query_id", "memory_id"], "left_semi"))
