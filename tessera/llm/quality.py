"""Quality rules: plain counts of each text, and perplexity bands of an n-gram model."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import buffers, documents, flattened, freed, in_small_batches, mix, pick, shingles, split_by_size, words, written

#: Bytes of an n-gram, at every size; and the longest n-grams a share of the model may have: with more, the model is cut into shares
#: of half as many on average, which are built, sent and applied one after the other.
ORDER, MOST_GRAMS = 5, 1 << 22
#: A band reaches from the median of a language's log perplexities to SPREAD times the distance of its outer deciles, which are
#: taken to lie DECILE median absolute deviations from it, as normal ones do: bad rows can't move these while they are under a half.
SPREAD, DECILE = 4.0, 1.9
#: And to this factor of the median at least, so that a language of even texts does not reject harmless ones.
LEAST_RATIO = 1.35
#: The model learns from texts that pass the base rules and have a symbol of `#*$%&|<>` in a hundredth of their words at most.
SYMBOLS = 0.01
#: Bands that are sent to all executors, at most; more go by a shuffled join.
MOST_LANGUAGES = 100_000
_START = 0xFF  # stands before a text's first byte; no UTF-8 text holds it
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def measured(raw: np.ndarray, at: np.ndarray, texts: list[bytes]) -> dict[str, np.ndarray]:
    """The plain counts of each text of a batch."""
    h, start, end, before = words(raw, at)
    n_words = np.diff(before)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    sign = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    chars = np.concatenate([[0], np.cumsum(lead[end] - lead[start])])
    grams, of = shingles(h, before, 3)
    key = mix(grams + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    twice = np.zeros(len(key), bool)
    twice[1:] = key[1:] == key[:-1]
    twice[:-1] |= twice[1:]
    many = order[twice]
    first = before[:-1][of[many]] + many - np.searchsorted(of, of[many])
    hit = np.zeros(len(h) + 3, bool)
    for k in range(3):
        hit[first + k] = True
    hits = np.concatenate([[0], np.cumsum(hit)])
    dup = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x and not x.isspace()]  # bytes.isspace knows the six space bytes only
            dup[i] = len(lines) - len(set(lines))
    return {"n_words": n_words, "word_chars": chars[before[1:]] - chars[before[:-1]], "n_symbols": sign[at[1:]] - sign[at[:-1]], "n_dup_lines": dup, "n_repeat_words": hits[before[1:]] - hits[before[:-1]]}


def base_failed(m: dict[str, np.ndarray]) -> np.ndarray:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def grams_of(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, in the low 8 * order bits, with start bytes before a text; and each byte's text."""
    n = np.diff(at)
    of = np.repeat(np.arange(len(n)), n)
    full = np.full(len(raw) + (order - 1) * len(n), _START, np.uint64)
    place = np.arange(len(raw)) + (order - 1) * (of + 1)
    full[place] = raw
    out = np.zeros(len(raw), np.uint64)
    for k in range(order):
        out = (out << np.uint64(8)) | full[place - (order - 1 - k)]
    return out, of


def gram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): how often each n-gram of bytes ends in the whole texts of a language, of all texts that pass the
    plain rules. Each task sums its own n-grams before the shuffle, so what is shuffled is the distinct ones of each task."""

    def run(batches):
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def sums(parts):
            g, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            at = np.argsort(g)
            g, n = g[at], n[at]
            first = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
            return g[first], np.add.reduceat(n, first) if len(g) else n

        def out():
            for lang, parts in held.items():
                g, n = sums(parts)
                yield pa.record_batch([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for b in split_by_size(batches, "text", 1 << 18):
            raw, at = buffers(b.column(1))
            got = measured(raw, at, [b""] * b.num_rows)
            b = b.filter(pa.array(~base_failed(got) & (got["n_symbols"] <= SYMBOLS * got["n_words"])))
            if not b.num_rows:
                continue
            g, of = grams_of(*buffers(b.column(1)), order)
            names, code = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
            code = code[of]
            for i, lang in enumerate(names):
                v = np.sort(g[code == i] if len(names) > 1 else g)
                if len(v):
                    first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                    parts = held.setdefault(str(lang), [])
                    parts.append((v[first], np.diff(np.append(first, len(v)))))
                    if len(parts) >= 16:
                        held[str(lang)] = [sums(parts)]
            if sum(len(p[0]) for x in held.values() for p in x) > MOST_GRAMS:
                yield from out()
        yield from out()

    return docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class KneserNey:
    """An interpolated modified Kneser-Ney model of bytes, one for each language, in sorted arrays of n-gram hashes.

    counts: for each order from 1 up, (language's number, n-gram, count); counts of lower orders are numbers of distinct bytes before.
    keys[n]: sorted hashes of (language, n-gram); prob[n]: natural logarithm; context[n], back[n]: hashes of contexts and the logarithm of what they leave.
    discounts: for each order, (languages, 4), if counts are a share of the model's; else they are taken from counts.
    """

    def __init__(self, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], discounts: list[np.ndarray] | None = None):
        self.langs, self.order = langs, len(counts)
        self.keys, self.prob, self.context, self.back, self.first = [], [], [], [], []
        for n, (lang, gram, c) in enumerate(counts, 1):
            ctx = self.key(n - 1, lang, gram >> np.uint64(8)) if n > 1 else self.key(0, lang, gram * np.uint64(0))
            uniq, at = np.unique(ctx, return_inverse=True)
            d = discounts[n - 1] if discounts else self.discounts(np.bincount(lang * 5 + np.minimum(c, 5) - 1, minlength=5 * len(langs)).reshape(-1, 5)[:, :4].tolist())
            total = np.bincount(at, c)
            taken = d[lang, np.minimum(c, 3)]
            left = np.bincount(at, taken) / total
            lower = np.full(len(gram), 1 / 256) if n == 1 else np.exp(self.find(n - 1, lang, gram & np.uint64((1 << 8 * (n - 1)) - 1)))
            p = (c - taken) / total[at] + left[at] * lower
            key = self.key(n, lang, gram)
            s = np.argsort(key)
            self.keys.append(key[s])
            self.prob.append(np.log(p[s]).astype(np.float32))
            # where keys with the same leading bits begin: hashes are spread evenly, so a key is a step or two from there
            bits = max(1, len(s)).bit_length()
            self.first.append(np.searchsorted(self.keys[-1], np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32))
            self.context.append(uniq)
            self.back.append(np.log(left).astype(np.float32))

    @staticmethod
    def discounts(seen: list[list[int]]) -> np.ndarray:
        """What n-grams seen once, twice and more often give up, from the numbers of those seen 1 to 4 times in each language."""
        d = np.zeros((len(seen), 4))
        for i, (n1, n2, n3, n4) in enumerate(seen):
            y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            d[i, 1:] = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return np.clip(d, 0.1, [0.1, 0.9, 1.9, 2.9])

    @staticmethod
    def key(n: int, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return mix(gram + (lang.astype(np.uint64) << np.uint64(44)) + (np.uint64(n) << np.uint64(41)))

    def find(self, n: int, lang: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of n-grams; unseen ones back off to shorter ones."""
        if n == 0:
            return np.full(len(gram), -np.log(256))
        keys, key = self.keys[n - 1], self.key(n, lang, gram)
        if not len(keys):
            return self.find(n - 1, lang, gram & np.uint64((1 << 8 * (n - 1)) - 1))
        first = self.first[n - 1]
        at = np.minimum(first[key >> np.uint64(64 - (len(first) - 1).bit_length())], len(keys) - 1)
        low = np.flatnonzero((keys[at] < key) & (at < len(keys) - 1))
        while len(low):
            at[low] += 1
            low = low[at[low] < len(keys) - 1]
            low = low[keys[at[low]] < key[low]]
        out = self.prob[n - 1][at].astype(np.float64)
        miss = np.flatnonzero(keys[at] != key)
        if len(miss):
            ctx = self.key(n - 1, lang[miss], gram[miss] >> np.uint64(8)) if n > 1 else self.key(0, lang[miss], gram[miss] * np.uint64(0))
            have = self.context[n - 1]
            c = np.minimum(np.searchsorted(have, ctx), len(have) - 1)
            out[miss] = np.where(have[c] == ctx, self.back[n - 1][c], 0) + self.find(n - 1, lang[miss], gram[miss] & np.uint64((1 << 8 * (n - 1)) - 1))
        return out


def share_of(salt, context, shares: int):
    """The share of a language (crc32 of its name) and the two bytes before an n-gram's last; of numbers, arrays or columns."""
    return (salt + context * 2654435761) % 1000003 % shares


class Shares:
    """A model in shares. The n-grams of three bytes or more of a language that agree in the two bytes before the last are in one share, and
    so are all they back off to and their contexts; n-grams of one and two bytes stand in each. So a share gives the very probabilities of the
    whole model, and what the driver or a worker holds at once is a share."""

    def __init__(self, tables: list[DataFrame], most: int):
        self.tables, self.order = tables, len(tables)
        top = tables[-1].count()
        self.n = 1 if top <= most else -(-2 * top // most)
        self.langs = sorted(r[0] for r in tables[0].select("lang").distinct().collect())
        self.discounts = None
        if self.n > 1:
            self.discounts = []
            for t in tables:
                seen = {r[0]: list(r[1:]) for r in t.groupBy("lang").agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()}
                self.discounts.append(KneserNey.discounts([seen[x] for x in self.langs]))

    def model(self, i: int) -> KneserNey:
        own = share_of(F.crc32(F.col("lang").cast("binary")), F.shiftright("gram", 8).bitwiseAND(0xFFFF), self.n) == i
        got = [(t.where(own) if self.n > 1 and k > 2 else t).toArrow() for k, t in enumerate(self.tables, 1)]
        number = {x: k for k, x in enumerate(self.langs)}
        return KneserNey(self.langs, [(np.array([number[x] for x in g.column("lang").to_pylist()], np.int64), g.column("gram").to_numpy().view(np.uint64), g.column("n").to_numpy().astype(np.int64)) for g in got], self.discounts)


def train(docs: DataFrame, order: int = ORDER, most: int = MOST_GRAMS) -> Shares:
    """Counts by Spark over all texts that pass the plain rules, in written tables; each order is kept, however many n-grams it has."""
    tables = [written(gram_counts(docs, order), "grams")]
    for n in range(order - 1, 0, -1):
        tables.append(tables[-1].groupBy("lang", F.expr(f"gram & {(1 << 8 * n) - 1}L").alias("gram")).agg(F.count("*").alias("n")))
    if tables[0].count() > most:  # shares read them again and again
        tables = tables[:1] + [written(t, "grams") for t in tables[1:]]
    return Shares(tables[::-1], most)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(m: KneserNey, raw, at, langs, share: int, shares: int) -> np.ndarray:
    """Of each text, the sum of the logarithms of those of its n-grams that are of a share."""
    g, of = grams_of(raw, at, m.order)
    number = {x: i for i, x in enumerate(m.langs)}
    code = np.array([number.get(x or "", len(number)) for x in langs], np.int64)
    if shares > 1:
        salt = np.array([zlib.crc32((x or "").encode()) for x in langs], np.int64)
        mine = share_of(salt[of], ((g >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.int64), shares) == share
        g, of = g[mine], of[mine]
    return np.bincount(of, m.find(m.order, code[of], g), minlength=len(at) - 1)


def scored(docs: DataFrame, model: Shares, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs, all columns, with the plain counts and log_ppl, the mean negative log probability of a byte (null for an empty text).

    With several shares docs are written with row numbers first, each share's sums are a table of numbers, and rows meet their sum by number."""
    in_small_batches(docs.sparkSession)
    sc, shares = docs.sparkSession.sparkContext, model.n
    if shares > 1:
        docs = written(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        parts = None
        for i in range(shares):
            sent = sc.broadcast(model.model(i))

            def add(batches, sent=sent, i=i):
                for b in split_by_size(batches, "text", 1 << 18):
                    raw, at = buffers(b.column(2).fill_null(""))
                    yield pa.record_batch([b.column(0), pa.array(_sums(sent.value, raw, at, b.column(1).to_pylist(), i, shares), pa.float64())], names=["_row", "_sum"])

            part = written(docs.select("_row", F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(add, "_row long, _sum double"), "sums")
            parts = part if parts is None else parts.unionByName(part)
            sent.destroy()
        docs = docs.join(parts.groupBy("_row").agg(F.sum("_sum").alias("_sum")), "_row").drop("_row")
    shared = sc.broadcast(model.model(0)) if shares == 1 else None
    freed(docs.sparkSession)  # the counts the model was made of

    def run(batches):
        for b in split_by_size(batches, text, 1 << 18):
            raw, at = buffers(b.column(b.schema.get_field_index(text)).fill_null(""))
            got = measured(raw, at, [raw[i:j].tobytes() for i, j in zip(at, at[1:])])
            if shared is None:
                total = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
                b = b.select(b.schema.names[:-1])
            else:
                total = _sums(shared.value, raw, at, b.column(b.schema.get_field_index(lang)).to_pylist(), 0, 1)
            n = np.diff(at)
            mean = -total / np.maximum(n, 1)
            yield pa.record_batch([*b.columns, *[pa.array(got[x], pa.int64()) for x in MEASURES], pa.array(base_failed(got), pa.bool_()), pa.array(mean, pa.float64(), mask=n == 0)], names=[*b.schema.names, *MEASURES, "base_failed", "log_ppl"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "_sum")
    return docs.mapInArrow(run, f"{kinds}, {', '.join(f'{x} long' for x in MEASURES)}, base_failed boolean, log_ppl double")


def _normal(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "lang", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def judge(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id, lang, the text's counts as in scored(), low and high, the perplexity band of its language, and kept.

    kept: not base_failed, and log_ppl within the band. The band is of the texts the model learnt from, or of all that don't fail the
    base rules in a language it learnt nothing of: the median plus and minus SPREAD * DECILE median absolute deviations, and a factor
    of LEAST_RATIO in perplexity at least.

    Null texts are empty and fail; a null language is one of its own; rows that repeat are judged alike; an
    empty table gives no rows; other columns are ignored. The model is of bytes, so a text of any length or script is scored whole.
    """
    rows = _normal(docs)
    return banded(written(scored(rows, train(rows)).drop("text"), "scored"))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names; a missing text is null, a missing language the empty one.
    Texts are scored once, in a written table; bands are read from its scores alone."""
    flat, at = flattened(docs)
    seen = flat.withColumns({"_text": F.col(at["text"]).cast("string") if "text" in at else F.lit(None).cast("string"), "_lang": F.coalesce(F.col(at["lang"]).cast("string"), F.lit("")) if "lang" in at else F.lit("")})
    out = written(scored(seen, train(_normal(docs)), "_text", "_lang"), "scored").withColumn("lang", F.col("_lang"))
    return banded(out).where("kept").select(*flat.columns).toDF(*docs.columns)


def banded(out: DataFrame) -> DataFrame:
    def each(rows):  # a row for each language
        return F.broadcast(rows) if rows.count() <= MOST_LANGUAGES else rows

    half = lambda c: F.percentile_approx(c, 0.5, 2000)
    fine = out.where("not base_failed").select("lang", "log_ppl", (F.col("n_symbols") <= SYMBOLS * F.col("n_words")).alias("learnt"))
    middle = fine.groupBy("lang").agg(F.coalesce(half(F.when(F.col("learnt"), F.col("log_ppl"))), half("log_ppl")).alias("mid"), F.max("learnt").alias("some"))
    off = fine.join(each(written(middle, "middles")), "lang").where("learnt or not some").groupBy("lang", "mid").agg(half(F.abs(F.col("log_ppl") - F.col("mid"))).alias("mad"))
    far = F.greatest(F.lit(float(np.log(LEAST_RATIO))), SPREAD * DECILE * F.col("mad"))
    bands = off.select("lang", (F.col("mid") - far).alias("low"), (F.col("mid") + far).alias("high"))
    out = out.join(each(written(bands, "bands")), "lang", "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(False)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge() of all documents; nulls, ties and repeated rows as there."""
    return judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "log_ppl", "low", "high")
