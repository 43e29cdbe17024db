"""Secret scans with DataFrame functions only: key patterns, and the Shannon entropy of sliding windows."""

from __future__ import annotations

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts

#: Fixed patterns of the base kinds, in this order.  Matches of ``assign`` count if the value has 6 characters; the
#: lengths of the others are part of their patterns (a run is matched as a whole or not at all).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Strings whose windows are measured: long, with letters and digits.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character class -> (what the whole string must match, window, least entropy of its best window in bits).  The first
#: that matches counts.
CLASSES = {
    "hexadecimal": (r"^[0-9a-fA-F]+$", 20, 2.9),
    "alphanumeric": (r"^[0-9A-Za-z]+$", 20, 3.6),
    "base64": (r"^[0-9A-Za-z+/_=-]+$", 20, 3.7),
}
#: Candidates that match one of these are no secrets: documented examples, placeholders, counting, UUIDs.
ALLOWED = (r"(?i)example|placeholder|dummy|changeme", r"(?i)(x{4}|0{6}|1{6})", r"(?i)0123456789|123456789|abcdefghij", r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")

_SPAN = "array<struct<start:long,rank:int,stop:long,text:string>>"


#: Matches that one fold gathers, and characters of a piece of a candidate: folds copy what they have gathered, and a
#: substring is found by walking to it, so both are kept short and long texts cost as many times more as they are longer.
GATHERED, PIECE = 64, 200


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once: a lambda's variable, where an expression would be computed at each use."""
    return F.get(F.transform(F.array(value), use), 0)


def spans(text: Column, pattern: str, rank: int, value_group: int | None = None, least: int = 0) -> Column:
    """(start, rank, stop, text) of the leftmost non-overlapping matches, in code points.

    The text is split at the matches; positions are running sums of the lengths of what lies between and of the matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    parts = bound(found, lambda f: F.arrays_zip(F.slice(between, F.lit(1), F.size(f)).alias("b"), f.alias("f"), (value if value_group else f).alias("v")))

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["b"])
        stop = start + F.length(x["f"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), x["f"].alias("text")))
        return F.struct(stop.alias("at"), (F.when(F.length(x["v"]) >= least, F.concat(s["out"], one)).otherwise(s["out"]) if least else F.concat(s["out"], one)).alias("out"))

    def in_groups(parts: Column) -> Column:
        first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / GATHERED).cast("int")), lambda k: F.aggregate(F.slice(parts, k * GATHERED + 1, F.lit(GATHERED)), first, add))
        return F.when(F.size(parts) > 0, bound(groups, placed)).otherwise(F.array().cast(_SPAN))

    def placed(groups: Column) -> Column:
        """The groups' spans moved by the lengths of the groups before."""
        ends = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
        starts = F.aggregate(groups, ends, lambda s, g: F.struct((s["at"] + g["at"]).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        moved = lambda g, by: F.transform(g["out"], lambda x: F.struct((x["start"] + by).alias("start"), x["rank"].alias("rank"), (x["stop"] + by).alias("stop"), x["text"].alias("text")))
        return F.flatten(F.zip_with(groups, starts, moved))

    return bound(parts, in_groups)


def best_entropy(candidate: Column, window: int, enough: float = float("inf")) -> Column:
    """The largest Shannon entropy of a window (0 without a whole window), by incremental counts: each step needs the count of
    the character that leaves and of the one that enters.  Where a window has ``enough``, the rest isn't measured."""
    term = F.array(*[F.lit(0.0 if c < 2 else c * log2(c)) for c in range(window + 1)])
    pieces = F.regexp_extract_all(candidate, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    # each piece with the beginning of the next one, so that every window lies in a piece
    whole = bound(pieces, lambda p: F.zip_with(p, F.concat(F.slice(p, F.lit(2), F.size(p)), F.array(F.lit(""))), lambda a, b: F.concat(a, F.substring(b, 1, window - 1))))
    count = lambda inside, c: F.length(inside) - F.length(F.replace(inside, c, F.lit("")))

    def of_piece(best: Column, piece: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            old, new = F.substring(piece, i - window, F.lit(1)), F.substring(piece, i, F.lit(1))
            stay = F.substring(piece, F.greatest(i - window + 1, F.lit(1)), F.least(i - 1, F.lit(window - 1)))
            leaves, enters = count(stay, old) + 1, count(stay, new)
            out = F.when(i > window, F.get(term, leaves - 1) - F.get(term, leaves)).otherwise(F.lit(0.0))
            total = s["total"] + out + F.get(term, enters + 1) - F.get(term, enters)
            bits = F.when(i >= window, F.lit(log2(window)) - total / window).otherwise(F.lit(0.0))
            return F.when(s["best"] >= enough, s).otherwise(F.struct(total.alias("total"), F.greatest(s["best"], bits).alias("best")))

        start = F.struct(F.lit(0.0).alias("total"), best.alias("best"))
        return F.aggregate(F.sequence(F.lit(1), F.length(piece)), start, step, lambda s: s["best"])

    return F.aggregate(whole, F.lit(0.0), lambda best, piece: F.when((best >= enough) | (F.length(piece) < window), best).otherwise(of_piece(best, piece)))


def is_random(candidate: Column, classes: dict = CLASSES, allowed: tuple = ALLOWED) -> Column:
    """Whether a candidate's best window reaches its class's entropy and no allow-list entry covers it."""
    out = F.lit(False)
    for pattern, window, least in reversed(list(classes.values())):
        out = F.when(F.rlike(candidate, F.lit(pattern)), best_entropy(candidate, window, least) >= least).otherwise(out)
    quiet = F.lit(False)
    for pattern in allowed:
        quiet = quiet | F.rlike(candidate, F.lit(pattern))
    return F.when(~F.rlike(candidate, F.lit("[0-9]")) | ~F.rlike(candidate, F.lit("[A-Za-z]")) | quiet, F.lit(False)).otherwise(out)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: dict = CLASSES, allowed: tuple = ALLOWED) -> DataFrame:
    """(doc_id, base, added): arrays of (start, rank, stop, text), by start and then rank; rank is a place in ``KINDS``.

    ``base`` are the pattern kinds; ``added`` are candidates of high entropy that overlap no base span and aren't
    allowed.  Null texts count as empty and have no spans.  Rows are scanned one by one; an empty table gives an empty table.
    """
    none = F.array().cast(_SPAN)
    t = F.col("text")
    low = F.lower(t)
    keyed = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    assign = F.when(keyed, spans(t, ASSIGN, 0, 2, 6)).otherwise(none)
    access = F.when(t.contains("AKIA"), spans(t, ACCESS, 1)).otherwise(none)
    hexes = F.when(F.rlike(t, F.lit(HEX)), spans(t, HEX, 2)).otherwise(none)
    long = F.when(F.rlike(t, F.lit(CANDIDATE)), spans(t, CANDIDATE, 3)).otherwise(none)
    rows = texts(docs, id_col, text_col).select("doc_id", F.array_sort(F.concat(assign, access, hexes)).alias("base"), long.alias("long"))
    free = F.filter("long", lambda c: ~F.exists("base", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    return rows.select("doc_id", "base", F.filter(free, lambda c: is_random(c["text"], classes, allowed)).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
