"""Ranked lexical search of many items at once, with common parts of the items evaluated once.

1. A pass over whole texts counts terms and keeps, of each document, its length and the frequencies of the items' terms
   (a written table: much smaller than the texts).
2. Sets of terms that items share are mined from the items: terms of the very same items first, then, again and again, the
   pair of parts that most items have together.  That makes a DAG: terms, shared sets over terms and smaller sets, items.
3. A task takes documents in batches.  It makes the accumulator of each shared set once, adds it to all sets and items above,
   and drops it; documents only meet an item in a vector of scores.  The best of each item leave the task; the rest is a
   ranking of few rows in two steps.
Items are taken in blocks of about ``BLOCK`` terms, so what is sent to tasks is bounded at any number of items.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import discard, lean, materialise, slices, texts
from .words import DIGITS, LETTERS, Terms

#: Terms of a block of items, about.
BLOCK = 20_000
#: Values of a batch of documents: terms of the block x documents.
CELLS = 4_000_000
#: An item's parts of which pairs are counted at a time; only the plan's quality depends on it, not the scores.
WIDE = 60
#: Groups that the tasks' best meet in first.
SALTS = 64


@dataclass
class Plan:
    """``nodes``: of each shared set and each item, the numbers of its parts; terms are 0 to n_leaves - 1, nodes follow, each
    after its parts.  ``tops``: (node, items) that end there."""

    n_leaves: int
    nodes: list[list[int]] = field(default_factory=list)
    tops: dict[int, list[int]] = field(default_factory=dict)

    @property
    def edges(self) -> int:
        return sum(map(len, self.nodes))

    def last_use(self) -> dict[int, int]:
        return {part: i + self.n_leaves for i, parts in enumerate(self.nodes) for part in parts}


def share_parts(items: Sequence[frozenset[int]], n_leaves: int) -> Plan:
    """A plan for items that are sets of leaves."""
    plan = Plan(n_leaves)

    def node(parts: Sequence[int]) -> int:
        plan.nodes.append(list(parts))
        return n_leaves + len(plan.nodes) - 1

    # equal items are one
    same: dict[frozenset[int], list[int]] = defaultdict(list)
    for i, x in enumerate(items):
        same[x].append(i)
    sets = list(same)
    # terms of the same two or more sets become one part
    where: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(sets):
        for leaf in x:
            where[leaf].append(i)
    alike: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for leaf, at in where.items():
        alike[tuple(at)].append(leaf)
    parts: list[set[int]] = [set() for _ in sets]
    users: dict[int, set[int]] = {}
    for at, leaves in alike.items():
        own = [node(sorted(leaves))] if len(at) > 1 and len(leaves) > 1 else leaves
        for p in own:
            users[p] = set(at)
            for i in at:
                parts[i].add(p)

    # then the pair that most sets hold becomes one part, until none is in two
    def common(i: int) -> list[int]:
        return heapq.nlargest(WIDE, (p for p in parts[i] if len(users[p]) > 1), key=lambda p: (len(users[p]), -p))

    pairs = Counter(tuple(sorted(ab)) for i in range(len(sets)) for ab in combinations(common(i), 2))
    heap = [(-n, ab) for ab, n in pairs.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        both = users[a] & users[b]
        if len(both) < 2:
            continue
        if len(both) < -n:  # it was counted before others took its sets
            heapq.heappush(heap, (-len(both), (a, b)))
            continue
        new = node([a, b])
        users[new] = both
        near: Counter = Counter()
        for i in both:
            parts[i] -= {a, b}
            near.update(common(i))
            parts[i].add(new)
        users[a], users[b] = users[a] - both, users[b] - both
        for p, n in near.items():
            if n > 1:
                heapq.heappush(heap, (-n, tuple(sorted((p, new)))))
    for i, x in enumerate(sets):
        plan.tops[node(sorted(parts[i]))] = same[x]
    return plan


@dataclass
class Queries:
    """A block of items: the vocabulary's numbers, leaves (term, repeats), and the plan over leaves."""

    vocabulary: dict[bytes, int]
    leaves: list[tuple[int, int]]
    plan: Plan
    rows: list[int]

    @classmethod
    def of(cls, items: Sequence[tuple[int, dict[bytes, int]]]) -> Queries:
        """``items``: (row, repeats of each term)."""
        vocabulary: dict[bytes, int] = {}
        leaves: dict[tuple[int, int], int] = {}
        sets = []
        for _, terms in items:
            own = [(vocabulary.setdefault(t, len(vocabulary)), n) for t, n in sorted(terms.items())]
            sets.append(frozenset(leaves.setdefault(x, len(leaves)) for x in own))
        return cls(vocabulary, list(leaves), share_parts(sets, len(leaves)), [i for i, _ in items])


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _index(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tf): each document's length and the frequencies of the vocabulary's terms as 32-bit numbers."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = Terms(LETTERS + DIGITS), sent.value
        for part in (p for batch in batches for p in slices(batch)):
            n, terms, tfs = [], [], []
            for text in part["text"].to_pylist():
                length, seen = 0, Counter()
                for some in split.of(text):
                    length += len(some)
                    seen.update(some)
                own = sorted((known[t], seen[t]) for t in known.keys() & seen.keys())
                n.append(length)
                terms.append(np.array([t for t, _ in own], "<u4").tobytes())
                tfs.append(np.array([k for _, k in own], "<i8").tobytes())
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())], names=["doc_id", "n", "terms", "tf"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, terms binary, tf binary")


def _frequencies(index: DataFrame) -> dict[int, int]:
    """The documents of each of a block's terms; as many rows as the block has terms at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(0, np.int64)
        for batch in batches:
            own = np.bincount(np.frombuffer(b"".join(batch["terms"].to_pylist()), "<u4"))
            if len(own) > len(df):
                df = np.pad(df, (0, len(own) - len(df)))
            df[: len(own)] += own
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["term", "df"])

    rows = index.select("terms").mapInArrow(lean(run), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in rows.collect()}


def _floor_shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def evaluate(plan: Plan, leaf: dict[int, tuple[np.ndarray, np.ndarray]], n_docs: int) -> Iterator[tuple[int, np.ndarray]]:
    """(node, scores of all documents of a batch) of the plan's tops.  ``leaf``: the documents and values of each leaf that has
    any.  Each shared set's accumulator is made once and dropped after its last use."""
    last, made = plan.last_use(), {}
    for at, parts in enumerate(plan.nodes, plan.n_leaves):
        out = None
        for p in parts:
            if p >= plan.n_leaves:
                x = made.get(p)
                if x is not None:
                    out = x.copy() if out is None else np.add(out, x, out=out)
                if last[p] == at:
                    made.pop(p, None)
            elif p in leaf:
                docs, values = leaf[p]
                if out is None:
                    out = np.zeros(n_docs, np.int64)
                out[docs] += values
        if out is None:
            continue
        if at in plan.tops:
            yield at, out
        else:
            made[at] = out


def _score(index: DataFrame, queries: Queries, weights: dict[int, int], n: int, total: int, k: int) -> DataFrame:
    """(row, doc_id, score, task): each task's best of each item."""
    sent = index.sparkSession.sparkContext.broadcast((queries.leaves, queries.plan, queries.rows, weights))
    size = max(256, CELLS // max(1, len(queries.vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, plan, rows, w = sent.value
        of_term: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, (t, times) in enumerate(leaves):
            of_term[t].append((i, times))
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # of a top: scores, ids and whether there is one
        for part in (batch.slice(lo, size) for batch in batches for lo in range(0, batch.num_rows, size)):
            at = np.repeat(np.arange(part.num_rows), [len(x) // 4 for x in part["terms"].to_pylist()])
            terms = np.frombuffer(b"".join(part["terms"].to_pylist()), "<u4").astype(np.int64)
            tf = np.frombuffer(b"".join(part["tf"].to_pylist()), "<i8")
            m = np.array([75 + 25 * x * n // total for x in part["n"].to_pylist()], np.int64)  # Python's numbers don't overflow
            share = _floor_shares(tf, m[at])
            order = np.argsort(terms, kind="stable")
            terms, at, share = terms[order], at[order], share[order]
            edges = np.flatnonzero(np.diff(terms, prepend=-1, append=-1))
            leaf = {}
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                t = int(terms[lo])
                for i, times in of_term[t]:
                    leaf[i] = (at[lo:hi], w[t] * times * share[lo:hi])
            ids = np.array([0 if x is None else x for x in part["doc_id"].to_pylist()], np.int64)
            null = part["doc_id"].is_null().to_numpy(zero_copy_only=False)
            for top, scores in evaluate(plan, leaf, part.num_rows):
                old = best.get(top)
                some = np.flatnonzero(scores >= old[0][-1]) if old is not None and len(old[0]) == k else np.flatnonzero(scores > 0)
                if not len(some):
                    continue
                s, i, e = scores[some], ids[some], ~null[some]
                if old is not None:
                    s, i, e = (np.concatenate(x) for x in zip(old, (s, i, e), strict=True))
                first = np.lexsort((i, e, -s))[:k]
                best[top] = s[first], i[first], e[first]
        told = [(np.full(len(s), rows[item]), s, i, e) for top, (s, i, e) in best.items() for item in plan.tops[top]]
        if told:
            r, s, i, e = (np.concatenate(x) for x in zip(*told, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(i, pa.int64(), mask=~e), pa.array(s), pa.array(np.full(len(s), TaskContext.get().partitionId()))], names=["row", "doc_id", "score", "task"])

    return index.mapInArrow(lean(run), "row long, doc_id long, score long, task long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item with a score above 0.

    Terms are runs of ASCII letters, digits and characters beyond ASCII.  Null and empty texts have none: such documents are
    found by no item, such items find none.  Equal scores rank by ascending id, null first; rows that repeat an id rank each.
    Items that repeat an id are ranked by themselves.  Empty tables give an empty table.  Other columns are ignored.
    """
    spark = docs.sparkSession
    found = None
    docs = texts(docs, id_col, text_col)
    asked = materialise(_asked(items, item_col, item_text_col), "items")
    blocks = max(1, -(-(asked.agg(F.sum("size")).first()[0] or 0) // block))
    n = total = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("row", "terms").collect()  # about BLOCK terms
        queries = Queries.of([(r.row, {bytes(t.term): t.times for t in r.terms}) for r in own])
        index = materialise(_index(docs, queries.vocabulary), "index")
        if n is None:
            n, total = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not own or not n:
            continue
        weights = {t: weight(n, df) for t, df in _frequencies(index).items()}
        rows = materialise(_score(index, queries, weights, n, total, k), "best")
        discard(index)
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], "row long, doc_id long, score long, task long")
    order = [F.desc("score"), F.asc_nulls_first("doc_id")]
    few = found.withColumn("rank", F.row_number().over(W.partitionBy("row", F.pmod("task", F.lit(SALTS))).orderBy(*order))).where(F.col("rank") <= k)
    last = few.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(*order))).where(F.col("rank") <= k)
    return last.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def _asked(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(row, item_id, terms, size) of each item."""
    rows = texts(items, item_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, row = Terms(LETTERS + DIGITS), TaskContext.get().partitionId() << 32
        kind = pa.list_(pa.struct([("term", pa.binary()), ("times", pa.int64())]))
        for part in (p for batch in batches for p in slices(batch)):
            terms = []
            for text in part["text"].to_pylist():
                seen: Counter = Counter()
                for some in split.of(text):
                    seen.update(some)
                terms.append([{"term": t, "times": c} for t, c in seen.items()])
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(terms)), pa.int64()), part["doc_id"], pa.array(terms, kind), pa.array([len(t) for t in terms], pa.int64())], names=["row", "item_id", "terms", "size"])
            row += len(terms)

    return rows.mapInArrow(lean(run), "row long, item_id long, terms array<struct<term: binary, times: long>>, size long")
