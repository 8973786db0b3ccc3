"""The engine's face: a store of memories on a path, with ingest, search, analytics, deletes, exports and tools."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring as S, temporal, text as X
from tessera.operators import analytics, blocks, graph, liquid, retrieval, store, vector
from tessera.plans.config import Config
from tessera.sources import extract, readers, sinks
from tessera.streaming import ingest


#: Weights as the older settings name them, and the signals they are of.
_WEIGHTS = {"w_semantic": "semantic", "w_recency": "recency", "w_actor": "actor", "w_spatial": "spatial", "w_usage": "usage"}


class Tools:
    """Named query templates that a model's tool calls run: name, description, parameters, and a function that gives a DataFrame."""

    def __init__(self):
        self.known: dict[str, tuple[str, dict, Callable[..., DataFrame]]] = {}

    def add(self, name: str, about: str, parameters: dict, run: Callable[..., DataFrame]) -> None:
        self.known[name] = about, parameters, run

    def about(self) -> list[dict]:
        return [{"name": n, "description": a, "parameters": p} for n, (a, p, _) in self.known.items()]

    def run(self, name: str, **arguments) -> DataFrame:
        if name not in self.known:
            raise KeyError(f"no tool of the name {name}")
        return self.known[name][2](**arguments)


class MemoryStore:
    """Memories in versions of one table; each write is a new version of what it changes, each read the last whole one."""

    def __init__(self, spark: SparkSession, path: str, embedder=None, config: Config | None = None, extractor=None, parser=None, decomposer=None):
        """extractor: for events worth several memories, see extract.parts_by(). parser: an object whose parse(text, as_of) gives a date hint, a dict with value (a
        relative word) or first and last, or None. decomposer: an object whose decompose(text) gives who (id), where (value), what and why, any of which may
        be missing. Where these are not given, or fail, the rules hold."""
        self.spark, self.embedder, self.config, self.extractor = spark, embedder or vector.HashingEmbedder(), config or Config(), extractor
        self.parser, self.decomposer = parser, decomposer
        self.table, self.tools = sinks.Versions(spark, f"{path}/memories"), Tools()
        self.tools.add("search_memories", "Finds memories like a text.", {"text": "string", "k": "integer"}, self.search)

    def memories(self) -> DataFrame:
        return self.table.read()

    def ingest(self, events: DataFrame) -> int:
        """Events (extract.EVENT) as memories with embeddings; those of the same event are replaced. Gives the version."""
        return self.table.change(extract.stored(events, self.config.get("multi_part_threshold"), self.embedder, self.extractor), "created_at")

    def ingest_stream(self, stream: DataFrame, name: str = "events"):
        """The writer of a query that ingests a stream of events as they come; an event that comes again takes the place of what it made before."""
        return ingest.upserts(stream, self.table, self.embedder, self.config.get("multi_part_threshold"), name, self.extractor)

    def ingest_records(self, records: DataFrame, session: str, at: str) -> int:
        """Records of an import as events of a session."""
        rows = readers.dispatched(records).where("content <> ''")
        return self.ingest(rows.select(F.concat(F.lit("evt_"), F.substring(F.md5("content"), 1, 12)).alias("event_id"), F.lit(session).alias("session_id"), "event_type", F.lit(at).cast("timestamp").alias("timestamp"), "actor", "content", F.create_map().cast("map<string,string>").alias("metadata")))

    def delete(self, ids: list[str] | None = None, session: str | None = None) -> int:
        gone = self.memories().where(F.col("memory_id").isin(ids or []) | (F.col("session_id") == session if session else F.lit(False)))
        return self.table.remove(gone)

    def decompose(self, text: str) -> dict:
        """A query's who, what, when, where, why, how and entities: the decomposer's, over the rules that a message of the same text would be read by."""
        event = self.spark.createDataFrame([("query", "analyzer", "user_message", None, "user:analyzer", text, {})], extract.EVENT)
        r = extract.single(event).select("*", X.entities(F.col("what")).alias("entities")).first()
        out = {"who": {"type": r.who_type, "id": r.who_id}, "what": r.what, "when": None, "where": {"type": r.where_type, "value": r.where_value}, "why": r.why, "how": r.how, "entities": r.entities[:20]}
        return out | {k: v for k, v in (self._decomposed(text) or {}).items() if v}

    def _decomposed(self, text: str) -> dict | None:
        try:
            return self.decomposer.decompose(text) if self.decomposer is not None else None
        except Exception:  # whatever a model's service raises
            return None

    def _hint(self, text: str, as_of: str) -> dict | None:
        """The parser's date hint, if it has one."""
        try:
            got = self.parser.parse(text, as_of) if self.parser is not None else None
        except Exception:
            return None
        if not got or not (got.get("value") or got.get("first")):
            return None
        return {"kind": "relative" if got.get("value") else "range", "value": got.get("value"), "first": got.get("first"), "last": got.get("last") or got.get("first")}

    def search(self, text: str, k: int | None = None, as_of: str | None = None, actor: str | None = None, budget: bool = False, weights: dict | None = None, overhead: int = 0) -> DataFrame:
        """Ranked memories for a text; its phrases of time are a date hint, of a day, a range or relative, and are not embedded. budget: only what fits
        the window beside overhead tokens. k, weights, grouping and half-life are the settings' unless they are given."""
        as_of = as_of or self.memories().agg(F.max("when_ts")).first()[0] or "1970-01-01"
        k = k or self.config.get("topk_semantic")
        if weights is None and any(x.startswith("weight_") for x in self.config.values):
            weights = self.config.weights()
        elif weights is None and any(x in self.config.values for x in _WEIGHTS):
            weights = {_WEIGHTS[x]: self.config.get(x) for x in _WEIGHTS}
        one = self.spark.createDataFrame([(0, text, actor)], "query_id int, text string, actor string")
        said = self._hint(text, as_of)
        hint = temporal.hint(F.col("text"), as_of) if said is None else F.struct(*[F.lit(said[c]).cast("string").alias(c) for c in ("kind", "value", "first", "last")])
        one = one.withColumns({"hint": hint, "clean": temporal.cleaned(F.col("text"))})
        row = one.select("clean", temporal.window(F.col("hint"), as_of).alias("w")).select("clean", "w.*").first()
        found = self._decomposed(text) or {}
        actor = actor or (found.get("who") or {}).get("id")
        place = (found.get("where") or {}).get("value")
        text = f"{text} {place}" if place and place.lower() not in text.lower() else text
        vec = [float(x) for x in self.embedder.encode([row.clean])[0]]
        q = self.spark.createDataFrame([(0, vec, text, actor, row.first, row.last, row.cap)], "query_id int, query array<float>, text string, actor string, first date, last date, cap int")
        grouping = self.config.get("grouping")
        found = retrieval.search(self.memories(), q, as_of, k, weights, grouping != "off", literal=grouping == "literal", half_life=self.config.get("half_life_hours"))
        if budget:
            window = [self.config.get(x) for x in ("context_window", "reserve_output_tokens", "reserve_system_tokens")]
            picked = blocks.knapsack(found, blocks.left(*window, overhead, True))
            found = found.join(picked.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_semi")
        return retrieval.cards(found).orderBy("rank")

    def context(self, text: str, k: int = 10, as_of: str | None = None) -> str:
        """The best memories as lines for a prompt."""
        ids = self.search(text, k, as_of).select("memory_id", "rank")
        rows = self.memories().join(ids, "memory_id").orderBy("rank").select(F.concat(F.lit("- "), F.col("what"), F.lit(" ("), F.substring(F.coalesce("why", F.lit("")), 1, 100), F.lit(")"))).limit(k)
        return "\n".join(r[0] for r in rows.collect())  # k rows

    def settle(self, clusters: DataFrame, energy: DataFrame, asked: DataFrame, co: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame, list[dict]]:
        """The clusters' loop over the store's vectors, at the settings' flow rate and merge threshold; see liquid.settled()."""
        rates = self.config.get("cluster_flow_rate"), self.config.get("cluster_merge_threshold")
        return liquid.settled(self.memories().select("memory_id", "embedding"), last, co, clusters, energy, asked, asked, *rates)

    def reinforce(self, synapses: DataFrame, activations: DataFrame, key: str) -> DataFrame:
        """Synapses after lists of activations, at the settings' rate, and one fall of all."""
        return graph.decay(graph.hebbian(synapses, activations, key, self.config.get("hebbian_rate")), self.config.get("synaptic_decay"))

    def stats(self) -> DataFrame:
        return analytics.totals(self.memories())

    def timeline(self, days: int | None = None) -> DataFrame:
        return analytics.filled(analytics.daily(self.memories(), days))

    def network(self, component: str = "what") -> DataFrame:
        return analytics.cooccurrence(analytics.items(self.memories(), component))

    def needs_fresh(self, text: str, as_of: str) -> bool:
        """Whether a text asks for what ages fast and no memory is young enough."""
        kind = self.spark.createDataFrame([(text,)], "t string").select(X.query_type(F.col("t"))).first()[0]
        young = S.age_hours(S.parsed(F.col("when_ts")), as_of) <= X.VALID_HOURS[kind]
        return kind in X.TIME_SENSITIVE and self.memories().where(young).isEmpty()

    def export(self, path: str, form: str = "json", time: str = "") -> None:
        rows = self.memories().drop("embedding")
        sinks.export_json(rows, path, time) if form == "json" else sinks.export_csv(rows, path)
