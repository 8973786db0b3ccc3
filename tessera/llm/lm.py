"""Scores of an n-gram model of words, whose Elias-Fano tries are shares of the n-grams, built and queried where the n-grams meet."""

from __future__ import annotations

import gc
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, buffers, documents, freed, mix, scratch, texts, trim, words, written
from tessera.llm.trie import Trie, coded, decoded

#: Words of an n-gram, at every size. A context seen c times leaves to the shorter one what T(c) = K * c ** POWER new words would weigh, with K for contexts of one word and of more.
ORDER, K, POWER = 3, (4.0, 1.0), 0.9
#: Documents with this remainder by FOLDS are held out.
FOLDS, HELD_OUT = 5, 1
#: Bytes of text of a block, a whole text at least; tokens of a share.
BLOCK_BYTES, SHARE_TOKENS = 8 << 20, 1_500_000
_END = np.uint64(0x1F2E3D4C5B6A7988)  # stands for the end of a text
_PIECE = 2 << 20
#: Of zstd.
LEVEL = 7
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def types(count: np.ndarray, order: int) -> np.ndarray:
    """T of contexts of order words."""
    return K[min(order, len(K)) - 1] * np.asarray(count, np.float64) ** POWER


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers that aren't negative, each in as many byte planes as its greatest one needs."""
    out = [struct.pack("<I", len(arrays))]
    for x in arrays:
        x = np.ascontiguousarray(x, np.int64)
        width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        out += [struct.pack("<QB", len(x), width), np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()]
    raw = b"".join(out)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", compression_level=LEVEL).compress(raw, asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = pa.decompress(data[8:], struct.unpack("<Q", data[:8])[0], "zstd", asbytes=True)
    at, out = 4, []
    for _ in range(struct.unpack("<I", raw[:4])[0]):
        n, width = struct.unpack("<QB", raw[at : at + 9])
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at + 9).reshape(width, n).T
        out.append(x.view("<i8").ravel())
        at += 9 + n * width
    return out


def _hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z as a-z, and the number of words of each; texts are cut between words, so what is needed at once is bounded."""
    raw, n, lo, out = _LOWER[raw], len(raw), 0, []
    count = np.zeros(len(at) - 1, np.int64)
    while lo < n:
        hi = min(lo + _PIECE, n)
        if hi < n:
            stop = at[np.searchsorted(at, hi, "right") - 1]
            gap = np.flatnonzero(SPACE[raw[lo:hi]])
            hi = max(stop, lo + gap[-1] + 1 if len(gap) else 0)
            if hi <= lo:  # a word longer than a piece
                gap = np.flatnonzero(SPACE[raw[lo:]])
                hi = min([int(at[np.searchsorted(at, lo, "right")]), *(lo + gap[:1] + 1)])
        h, _, _, before = words(raw[lo:hi], np.clip(at, lo, hi) - lo)
        count += np.diff(before)
        out.append(h)
        lo = hi
    return np.concatenate([*out, np.zeros(0, np.uint64)]), count


def blocks(docs: DataFrame) -> DataFrame:
    """(block, doc_ids, tokens, data): documents in blocks of BLOCK_BYTES, each token the place of its hash among the block's sorted ones. data: tokens
    of each document, whether it is held out, differences of the sorted hashes, the training tokens of each, and the tokens' places."""

    def run(batches):
        ids, lens, hashes, size, made = [], [], [], 0, 0

        def out():
            nonlocal ids, lens, hashes, size, made
            n = np.concatenate(lens) + 1
            end = np.cumsum(n) - 1
            h = np.full(int(n.sum()), _END)
            body = np.ones(len(h), bool)
            body[end] = False
            h[body] = np.concatenate(hashes)
            held = np.array([zlib.crc32(b"" if x is None else str(x).encode()) % FOLDS == HELD_OUT for x in ids])
            uniq, code = np.unique(h, return_inverse=True)
            train = np.bincount(code, np.repeat(~held, n), len(uniq))
            step = np.diff(uniq, prepend=np.uint64(0)).view(np.int64)
            data = packed(n, held, step >> 32, step & 0xFFFFFFFF, train, code)
            b = pa.record_batch([pa.array([(TaskContext.get().partitionId() << 32) + made]), pa.array([ids], pa.list_(pa.int64())), pa.array([int(n[~held].sum())], pa.int64()), pa.array([len(h)], pa.int64()), pa.array([data], pa.binary())], names=["block", "doc_ids", "train", "tokens", "data"])
            ids, lens, hashes, size, made = [], [], [], 0, made + 1
            return b

        for b in batches:
            raw, at = buffers(b.column(1))
            i = 0
            while i < b.num_rows:  # a block ends with the text that fills it
                j = min(b.num_rows, i + int(np.searchsorted(at[i + 1 :] - at[i] + size, BLOCK_BYTES)) + 1)
                h, n = _hashes(raw[at[i] : at[j]], at[i : j + 1] - at[i])
                ids += b.column(0).slice(i, j - i).to_pylist()
                lens.append(n)
                hashes.append(h)
                size += int(at[j] - at[i])
                i = j
                if size >= BLOCK_BYTES:
                    yield out()
        if ids:
            yield out()
        trim()

    return texts(docs).mapInArrow(run, "block long, doc_ids array<long>, train long, tokens long, data binary")


def _bins(h: np.ndarray, n: int) -> np.ndarray:
    """A share of n for each 64-bit hash, by its leading bits."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)



def _sorted_hashes(data: list[np.ndarray]) -> np.ndarray:
    return np.cumsum((data[2].view(np.uint64) << np.uint64(32)) | data[3].view(np.uint64), dtype=np.uint64)


def vocabulary(made: DataFrame, shares: int) -> DataFrame:
    """(block, share, words, data): for each block, the ids and training counts of its words, in the order of their hashes; a word that isn't in the training
    texts has id 0. words is the number of training words of the share. Ids are dense: a word's place in its share, by falling count, times shares, plus the share's number."""

    def ask(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = unpacked(data)
                h = _sorted_hashes(got)
                cut = np.searchsorted(_bins(h, shares), np.arange(shares + 1))
                step = np.diff(h, prepend=np.uint64(0))
                rows = [(s, packed((step[i:j] >> np.uint64(32)).view(np.int64), (step[i:j] & np.uint64(0xFFFFFFFF)).view(np.int64), got[4][i:j]), int(h[i - 1]) if i else 0) for s, (i, j) in enumerate(zip(cut, cut[1:])) if j > i]
                yield pa.record_batch([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.uint64()).view(pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "share", "before", "data"])

    def answer(key, table):
        asked = [unpacked(x) for x in table.column("data").to_pylist()]
        h = np.concatenate([np.cumsum((hi.view(np.uint64) << np.uint64(32)) | lo.view(np.uint64), dtype=np.uint64) + np.uint64(before % 2**64) for (hi, lo, _), before in zip(asked, table.column("before").to_pylist())])
        uniq, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, np.concatenate([n for _, _, n in asked]), len(uniq)).astype(np.int64)
        share = key[0].as_py()
        ids = np.empty(len(c), np.int64)
        ids[np.argsort(-c, kind="stable")] = np.arange(len(c)) * shares + share + 1  # frequent words have small ids, which take less room
        ids[c == 0] = 0
        ids, c, cut = ids[at], c[at], np.cumsum([0, *(len(x[0]) for x in asked)])
        n = table.num_rows
        return pa.table([table.column("block"), pa.array([share] * n, pa.int32()), pa.array([int(np.count_nonzero(np.bincount(at, np.concatenate([x for _, _, x in asked]))))] * n, pa.int64()), pa.array([packed(ids[i:j], c[i:j]) for i, j in zip(cut, cut[1:])], pa.binary())], names=["block", "share", "words", "data"])

    return made.select("block", "data").mapInArrow(ask, "block long, share int, before long, data binary").groupBy("share").applyInArrow(answer, "block long, share int, words long, data binary")


def coded_blocks(made: DataFrame, known: DataFrame) -> DataFrame:
    """(block, doc_ids, data): blocks whose tokens are places among their words' sorted ids, 0 for all unknown words. data: tokens of each
    document, whether it is held out, ids (0 first), training counts, and the tokens' places."""

    def code(key, block, answers):
        n, held, _, _, _, at = unpacked(block.column("data")[0].as_py())
        parts = [unpacked(x) for _, x in sorted(zip(answers.column("share").to_pylist(), answers.column("data").to_pylist()))]
        ids, c = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(ids, kind="stable")
        some = order[np.searchsorted(ids[order], 1) :]
        place = np.zeros(len(ids), np.int64)
        place[some] = np.arange(1, len(some) + 1)
        data = packed(n, held, np.append(0, ids[some]), np.append(0, c[some]), place[at])
        return pa.table([block.column("block"), block.column("doc_ids"), pa.array([data], pa.binary())], names=["block", "doc_ids", "data"])

    return made.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(code, "block long, doc_ids array<long>, data binary")


class Walks:
    """The distinct n-grams of a block that begin with two known words: levels 2 to order, by first word, second word and so on. A walk that meets an
    unknown word or the end of its document goes on with 0.

    start: tokens at which a walk begins, and node[k] for each of them its node of level k; parent[k], word[k]: of each node its parent's place
    (of level 2: its first word's) and its last word. Words are places among the block's ids.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray, order: int):
        left = np.repeat(np.cumsum(n), n) - np.arange(len(code))  # tokens from here to the document's end
        after = [code]
        for k in range(1, order):
            x = np.zeros(len(code), np.int64)
            x[: len(code) - k] = code[k:]
            x[(left <= k) | (after[-1] == 0)] = 0
            after.append(x)
        self.start = np.flatnonzero(after[1] > 0)
        self.parent, self.word, self.node = {}, {}, {}
        above = after[0][self.start]
        for k in range(2, order + 1):
            uniq, above = np.unique((above << 32) | after[k - 1][self.start], return_inverse=True)
            self.parent[k], self.word[k], self.node[k] = uniq >> 32, uniq & 0xFFFFFFFF, above

    def dealt(self, ids: np.ndarray, shares: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
        """Of each level, its nodes by share, and where each share's begin. A share is chosen by the first two words, so that all nodes of a walk are in one."""
        one, two = ids[self.parent[2]].view(np.uint64), ids[self.word[2]].view(np.uint64)
        share, order, cut = _bins(mix(mix(one) + two), shares), {}, {}
        for k in self.parent:
            if k > 2:
                share = share[self.parent[k]]
            order[k] = np.argsort(share, kind="stable")
            cut[k] = np.searchsorted(share[order[k]], np.arange(shares + 1))
        return order, cut


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, int)


def asked(blocks: DataFrame, shares: int, order: int) -> DataFrame:
    """(block, share, data): the block's n-grams of a share: differences of the sorted first words, their counts and numbers of second words; for each level from 2 up the last
    words, and numbers of next words; and the training count of each n-gram of the last level. A row has an n-gram at least, so there are never more rows than n-grams."""

    def run(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, held, ids, c, code = unpacked(data)
                w = Walks(code, n, order)
                count = np.bincount(w.node[order], np.repeat(held == 0, n)[w.start], len(w.word[order])).astype(np.int64)
                nodes, cut = w.dealt(ids, shares)
                rows = []
                for s in range(shares):
                    own = {k: nodes[k][cut[k][s] : cut[k][s + 1]] for k in nodes}
                    if not len(own[2]):
                        continue
                    first = w.parent[2][own[2]]
                    at = _runs(first)
                    out = [np.diff(ids[first[at]], prepend=0), c[first[at]], np.diff(np.append(at, len(first)))]  # first words rise
                    for k in range(2, order + 1):
                        out.append(ids[w.word[k][own[k]]])
                        if k < order:
                            out.append(np.diff(np.append(_runs(w.parent[k + 1][own[k + 1]]), len(own[k + 1]))))
                    rows.append((s, packed(*out, count[own[order]])))
                yield pa.record_batch([pa.array([block] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "share", "data"])
                del w, nodes, rows
                trim()

    return blocks.select("block", "data").mapInArrow(run, "block long, share int, data binary")


class Asked:
    """What asked() packs: first, count; for each level parent and word; and the training counts."""

    def __init__(self, data: bytes, order: int):
        got = unpacked(data)
        self.first, self.count, more = np.cumsum(got[0]), got[1], got[2]
        self.parent, self.word = {}, {}
        for k in range(2, order + 1):
            self.parent[k] = np.repeat(np.arange(len(more)), more)
            self.word[k] = got[2 * k - 1]
            more = got[2 * k] if k < order else more
        self.train = got[-1]


def trained(parts: list[Asked], order: int):
    """The trie of the n-grams that some training text has, from all blocks' walks of a share.

    A node's probability is its count, of its context's count and T of that, so that with what the context leaves, T of the same, to the shorter n-gram
    all probabilities after a context sum to 1.
    """
    live = [p.train > 0 for p in parts]
    rows = {order: live}
    for k in range(order, 1, -1):
        up = []
        for p, x in zip(parts, rows[k]):
            keep = np.zeros(len(p.word[k - 1]) if k > 2 else len(p.first), bool)
            keep[p.parent[k][x]] = True
            up.append(keep)
        rows[k - 1] = up
    first, above = np.unique(np.concatenate([p.first[x] for p, x in zip(parts, rows[1])]), return_inverse=True)
    context = np.zeros(len(first), np.int64)
    context[above] = np.concatenate([p.count[x] for p, x in zip(parts, rows[1])])
    levels, base = [], above
    for k in range(2, order + 1):
        word = np.concatenate([p.word[k][x] for p, x in zip(parts, rows[k])])
        shift, links = 0, []
        for p, x, y in zip(parts, rows[k], rows[k - 1]):
            place = np.cumsum(y) - 1
            links.append(place[p.parent[k][x]] + shift)
            shift += int(y.sum())
        up, most = base[np.concatenate(links)], int(word.max(initial=0)) + 1
        if int(up.max(initial=0)) + 1 < (1 << 62) // most:  # the two in one number
            uniq, base = np.unique(up * most + word, return_inverse=True)
            levels.append((uniq // most, uniq % most))
        else:
            names, place = np.unique(word, return_inverse=True)
            uniq, base = np.unique(up * len(names) + place, return_inverse=True)
            levels.append((uniq // len(names), names[uniq % len(names)]))
    count = np.bincount(base, np.concatenate([p.train[x] for p, x in zip(parts, live)]), len(levels[-1][0])).astype(np.int64)
    counts = {order: count}
    for k in range(order, 2, -1):
        counts[k - 1] = np.bincount(levels[k - 2][0], counts[k], len(levels[k - 3][0])).astype(np.int64)
    counts[1], out = context, []
    place = np.arange(len(first))
    for k in range(2, order + 1):
        parent, word = levels[k - 2]
        c, up = counts[k], counts[k - 1][parent]
        real = word > 0
        moved = np.cumsum(real) - 1
        out.append((place[parent][real], word[real], coded(c / (up + types(up, k - 1)))[real], coded(types(c, k) / (c + types(c, k)))[real]))
        place = np.where(real, moved, -1)
    return Trie.build(first, out)


def answered(walks: DataFrame, order: int) -> DataFrame:
    """(block, share, data): for each walk's nodes, the coded probability, and but for the last level what the node leaves to shorter contexts, as the trie of the share has
    them. A share's n-grams of all blocks meet in one task, which is where its trie is built, mapped and searched; it holds SHARE_TOKENS tokens on average."""

    def run(key, table):
        parts = [Asked(x, order) for x in table.column("data").to_pylist()]
        trie, out = Trie(trained(parts, order), order), []
        for p in parts:
            at, data = trie.firsts(p.first), []
            for k in range(2, order + 1):
                at = trie.children(k, at[p.parent[k]], p.word[k])
                for values in (trie.prob[k], trie.back[k])[: 1 + (k < order)]:
                    x = np.zeros(len(at), np.int64)
                    x[at >= 0] = values[at[at >= 0]]
                    data.append(x)
            out.append(packed(*data))
        del trie
        trim()
        return pa.table([table.column("block"), table.column("share"), pa.array(out, pa.binary())], names=["block", "share", "data"])

    return walks.groupBy("share").applyInArrow(run, "block long, share int, data binary")


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def summed(blocks: DataFrame, answers: DataFrame, order: int, shares: int, total: int, v: int) -> DataFrame:
    """The scores of each document. An n-gram's probability is its trie's, plus what its context leaves times the probability without its first word."""

    def run(key, block, got):
        n, held, ids, c, code = unpacked(block.column("data")[0].as_py())
        p = (c[code] + 0.5) / (total + 0.5 * (v + 1))
        base = np.log10(p)
        w = Walks(code, n, order)
        nodes, _ = w.dealt(ids, shares)
        parts = [unpacked(x) for _, x in sorted(zip(got.column("share").to_pylist(), got.column("data").to_pylist()))]
        column = 0
        known = c[code]
        left = np.where(known > 0, types(known, 1) / np.maximum(known + types(known, 1), 1e-300), 1.0)  # what a context of one word leaves
        for k in range(2, order + 1):
            def each(i):
                x = np.zeros(len(w.word[k]), np.int64)
                x[nodes[k]] = np.concatenate([y[i] for y in parts] or [x])
                return x

            prob = np.zeros(len(code))
            prob[w.start] = decoded(each(column), 0.0)[w.node[k]]
            # token i + k - 1 ends the k words from i on, unless these leave the document, where the context is shorter
            have = np.arange(len(code)) + k - 1 < np.repeat(np.cumsum(n), n)
            i = np.flatnonzero(have)
            p[i + k - 1] = prob[i] + left[i] * p[i + k - 1]
            if k < order:
                left = np.ones(len(code))
                left[w.start] = decoded(each(column + 1), 1.0)[w.node[k]]
            column += 2
        doc = np.repeat(np.arange(len(n)), n)
        sums = [np.bincount(doc, x, len(n)) for x in (known > 0, base, np.log10(p))]
        trim()
        return pa.table([block.column("doc_ids").combine_chunks().flatten(), pa.array(held > 0), pa.array(n), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(sums[1]), pa.array(sums[2])], names=[x.split()[0] for x in _SCORES.split(", ")])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _SCORES)


def scores(docs: DataFrame, order: int = ORDER, share_tokens: int = SHARE_TOKENS) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of the whole text, by the words' counts alone,
    and by the n-gram model. The model learns from all rows whose crc32 of doc_id as text isn't 1 modulo 5.

    Probabilities are smoothed by interpolation in the manner of Witten and Bell, with a context's number of next words taken as K * c ** POWER of its
    count c: so each needs the counts of an n-gram and its context only, and these are in one share, as a share is chosen by the first two words.

    1. Texts become blocks of tokens. 2. Each block asks for its distinct words' ids and counts, in a shuffle by share of the words. 3. Each block asks
    for its distinct n-grams, in a shuffle by share of the n-grams; the share's task builds its trie from the training counts that came along, and
    answers. 4. Each block sums its documents. Shares grow in number with the tokens, not in size, so nothing is sent to all executors or the driver but
    numbers; and a frequent word or pair comes once from each block that has it.

    Words are told apart by 64-bit hashes. Logarithms in the tries are rounded to a 2048th. Null texts are empty ones, of one token, their end; a row without doc_id is
    one to learn from; rows that repeat are learnt and scored each; without rows to learn from all tokens are unknown; an empty table gives no
    rows; other columns are ignored.
    """
    spark = docs.sparkSession

    def done() -> None:  # shuffle files go when nothing holds their step's plan
        gc.collect()
        freed(spark)

    with scratch(spark) as tables:
        made = written(blocks(docs), "blocks")
        total, tokens = made.agg(F.sum("train"), F.sum("tokens")).first()
        shares = max(2, -(-(tokens or 0) // share_tokens))
        known = written(vocabulary(made, shares), "words")
        v = known.groupBy("share").agg(F.first("words").alias("n")).agg(F.sum("n")).first()[0] or 0
        done()
        ready = written(coded_blocks(made, known), "coded")
        tables.pop()  # read until the end
    done()
    answers = written(answered(asked(ready, shares, order), order), "answers")
    done()
    return summed(ready, answers, order, shares, total or 0, v)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores() of all documents; nulls, ties and repeated rows as there."""
    return scores(documents(spark, sf_dir))
