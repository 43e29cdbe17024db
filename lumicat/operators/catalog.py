"""Catalog operators: predicates, facets, order, originals, queue and listing changes.

All are plain DataFrame expressions; what needs a total order states its key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import photo

# ---- predicates


@dataclass
class ExifFilter:
    """Ranges are inclusive with a tolerance; empty sets and None pass."""

    fnumber: tuple[float, float] | None = None
    shutter: tuple[float, float] | None = None
    focal: tuple[float, float] | None = None
    iso: tuple[int, int] | None = None
    filetypes: tuple[str, ...] = ()
    cameras: tuple[str, ...] = ()
    lenses: tuple[str, ...] = ()
    expcomps: tuple[str, ...] = ()


@dataclass
class BrowserFilter:
    """OR inside a field, AND across fields; an empty field passes all."""

    ranks: tuple[int, ...] = ()
    labels: tuple[int, ...] = ()
    edited: bool | None = None
    recently_saved: bool | None = None
    show_trash: bool = True
    show_not_trash: bool = True
    originals_only: bool = False
    names: str = ""
    exif: ExifFilter = field(default_factory=ExifFilter)


def name_predicate(file: Column, names: str) -> Column:
    """``!=`` before the list negates it; items are separated by commas, empty ones ignored, case too."""
    negated = names.startswith("!=")
    items = [x.strip().upper() for x in (names[2:] if negated else names).split(",") if x.strip()]
    if not items:
        return F.lit(True)
    hit = reduce(lambda a, b: a | b, [F.contains(F.upper(photo.base_name(file)), F.lit(x)) for x in items])
    return ~hit if negated else hit


def exif_predicate(spec: ExifFilter) -> Column:
    """Ranges apply only where the EXIF data is valid; sets always."""
    sets = [F.col(c).isin(*v) for c, v in (("filetype", spec.filetypes), ("camera", spec.cameras), ("lens", spec.lenses), ("expcomp", spec.expcomps)) if v]
    tolerance = {"fnumber": 1e-8, "shutter": 1e-8, "focal": 0.01, "iso": 0}
    ranges = [F.col(c).between(v[0] - tolerance[c], v[1] + tolerance[c]) for c in tolerance if (v := getattr(spec, c))]
    out = reduce(lambda a, b: a & b, sets, F.lit(True))
    return out & (~F.col("exif_valid") | reduce(lambda a, b: a & b, ranges, F.lit(True)))


def predicate(spec: BrowserFilter) -> Column:
    """The filter as one Column, so that its simple terms reach the scan."""
    terms = [F.col(c).isin(*v) for c, v in (("rank", spec.ranks), ("color_label", spec.labels)) if v]
    terms += [F.col(c) == v for c, v in (("edited", spec.edited), ("recently_saved", spec.recently_saved)) if v is not None]
    if not spec.show_trash:
        terms.append(~F.col("in_trash"))
    if not spec.show_not_trash:
        terms.append(F.col("in_trash"))
    if spec.originals_only:
        terms.append(F.col("is_original"))
    if spec.names:
        terms.append(name_predicate(F.col("file"), spec.names))
    return reduce(lambda a, b: a & b, [*terms, exif_predicate(spec.exif)])


def apply_filter(shots: DataFrame, spec: BrowserFilter) -> DataFrame:
    return shots.where(predicate(spec))


def filtered_selection(shots: DataFrame, selection: DataFrame, spec: BrowserFilter) -> DataFrame:
    """The selected rows that still pass."""
    return apply_filter(shots, spec).join(selection.select("shot_id"), "shot_id", "left_semi")


# ---- order


def order_keys(method: str, descending: bool = False) -> list[Column]:
    """Sort keys with the name as last key; descending reverses the whole key."""
    first = {"name": [], "date": ["taken"], "exif": ["camera", "lens", "fnumber", "shutter", "iso"], "rank": ["rank"], "label": ["color_label"]}[method]
    return [F.col(c).desc() if descending else F.col(c).asc() for c in (*first, "file", "shot_id")]


def resort(shots: DataFrame, method: str, descending: bool = False) -> DataFrame:
    return shots.orderBy(*order_keys(method, descending))


def neighbours(visible: DataFrame, within: str, *order: str) -> DataFrame:
    """Each visible row's next and previous one in the listing of its folder."""
    w = W.partitionBy(within).orderBy(*order)
    return visible.withColumn("next_id", F.lead("shot_id").over(w)).withColumn("prev_id", F.lag("shot_id").over(w))


# ---- facets


def facets(shots: DataFrame, *by: str) -> DataFrame:
    """Ranges and value sets of the EXIF panel, one row a group: partial aggregates, then one merge."""
    positive = F.when(F.col("iso") > 0, F.col("iso"))
    aggregates = [f(c).alias(f"{k}_{c}") for c in ("fnumber", "shutter", "focal") for k, f in (("min", F.min), ("max", F.max))]
    aggregates += [F.min(positive).alias("min_iso"), F.max(positive).alias("max_iso")]
    aggregates += [F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in ("filetype", "camera", "lens", "expcomp")]
    return shots.groupBy(*by).agg(*aggregates)


# ---- originals


def mark_originals(shots: DataFrame, priority: list[str], folder: str = "folder") -> DataFrame:
    """Groups of equal folder and base name (without case and extension): one original each, ``original_id`` links the rest.

    The first row seen starts as the original.  If its extension is listed, the best listed extension (then the first
    seen) replaces it; if it isn't, it stays.
    """
    stem = F.lower(photo.without_extension(photo.base_name("file")))
    rank = F.array_position(F.array(*[F.lit(x) for x in priority]), photo.file_type("file"))
    keyed = shots.withColumn("_stem", stem).withColumn("_rank", F.when(rank == 0, F.lit(None)).otherwise(rank))
    row = F.struct(F.coalesce("_rank", F.lit(1 << 30)).alias("rank"), F.col("shot_id").alias("id"))
    best = keyed.groupBy(folder, "_stem").agg(F.min(F.struct(F.col("shot_id").alias("id"), F.col("_rank").alias("rank"))).alias("first"), F.min(row).alias("best"))
    chosen = best.select(folder, "_stem", F.when(F.col("first.rank").isNull(), F.col("first.id")).otherwise(F.col("best.id")).alias("original_id"))
    joined = keyed.join(chosen, [folder, "_stem"])
    return joined.withColumn("is_original", F.col("shot_id") == F.col("original_id")).drop("_stem", "_rank")


# ---- names


def unique_names(files: DataFrame, name: str, *order: str, limit: int = 100) -> DataFrame:
    """``unique_name``: the second and later rows of a name get -1, -2, ... before the extension; null from ``limit`` on."""
    k = F.row_number().over(W.partitionBy(name).orderBy(*order)) - 1
    c = F.col(name)
    suffixed = F.concat(photo.without_extension(c), F.lit("-"), k.cast("string"), F.when(photo.extension(c) == "", F.lit("")).otherwise(F.concat(F.lit("."), photo.extension(c))))
    return files.withColumn("unique_name", F.when(k == 0, c).when(k < limit, suffixed))


# ---- queue


def head_items(queue: DataFrame, selected: Column) -> DataFrame:
    """New positions with the selection behind the entries in process and before the rest.

    The queue's order is total over one table; it is dealt into ranges by sorting, not into one task: positions are
    counts of what sorts before.
    """
    return _placed(queue, F.when(F.col("processing"), 0).when(selected, 1).otherwise(2))


def tail_items(queue: DataFrame, selected: Column) -> DataFrame:
    return _placed(queue, F.when(F.col("processing"), 0).when(~selected, 1).otherwise(2))


def _placed(queue: DataFrame, group: Column) -> DataFrame:
    """Positions by (group, seq).  Ranks are computed inside the groups' blocks of ``seq`` and offset by block counts."""
    block = F.floor(F.col("seq") / 4096)
    keyed = queue.withColumn("_g", group).withColumn("_b", block)
    counts = keyed.groupBy("_g", "_b").agg(F.count("*").alias("_n"))
    # one row a block: 1/4096 of the queue
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_g", "_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy("_g", "_b").orderBy("seq"))
    return keyed.withColumn("_k", inside).join(before, ["_g", "_b"]).withColumn("position", F.col("_before") + F.col("_k") - 1).drop("_g", "_b", "_k", "_before")


def add_entries(queue: DataFrame, entries: DataFrame, head: bool = False) -> DataFrame:
    """Appends ``entries``; at the head each goes before the first entry not in process, so several come out reversed."""
    if not head:
        top = queue.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("top"))
        return queue.unionByName(entries.crossJoin(F.broadcast(top)).withColumn("seq", F.col("seq") + F.col("top") + 1).drop("top"))
    bound = queue.agg(F.coalesce(F.min(F.when(~F.col("processing"), F.col("seq"))), F.coalesce(F.max("seq"), F.lit(-1)) + 1).alias("at"))
    size = entries.agg(F.count("*").alias("n"))
    shifted = queue.crossJoin(F.broadcast(bound)).crossJoin(F.broadcast(size))  # two tables of one row
    shifted = shifted.withColumn("seq", F.when(F.col("seq") >= F.col("at"), F.col("seq") + F.col("n")).otherwise(F.col("seq"))).drop("at", "n")
    fresh = entries.crossJoin(F.broadcast(bound)).crossJoin(F.broadcast(size)).withColumn("seq", F.col("at") + F.col("n") - 1 - F.col("seq")).drop("at", "n")
    return shifted.unionByName(fresh)


def cancel_items(queue: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Removes the selected entries, except those in process."""
    gone = queue.where(~F.col("processing")).join(selected.select(key), key, "left_semi").select(key)
    return queue.join(gone, key, "left_anti")


# ---- changes


def delete_entries(shots: DataFrame, files: DataFrame) -> DataFrame:
    return shots.join(files.select("file"), "file", "left_anti")


def empty_trash(shots: DataFrame) -> DataFrame:
    return shots.where(~F.col("in_trash"))


def trash_is_empty(shots: DataFrame) -> DataFrame:
    """One row; reading stops at the first trashed one."""
    return shots.where("in_trash").limit(1).agg((F.count("*") == 0).alias("is_empty"))


def set_where(shots: DataFrame, selected: Column, **values) -> DataFrame:
    """Ranks, labels or trash flags of the selected rows."""
    return shots.withColumns({c: F.when(selected, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def listing_changes(old: DataFrame, new: DataFrame, key: str = "file") -> DataFrame:
    """(file, change): what a new listing of a folder adds and removes."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("change", F.lit("removed")).unionByName(b.join(a, key, "left_anti").withColumn("change", F.lit("added")))


def copy_or_move(shots: DataFrame, selected: DataFrame, folder: str, move: bool) -> DataFrame:
    """The catalog after copying or moving the selected files into ``folder``; taken names get a suffix."""
    chosen = shots.join(selected.select("shot_id"), "shot_id", "left_semi")
    target = chosen.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), photo.base_name("file")))
    stay = shots.join(selected.select("shot_id"), "shot_id", "left_anti") if move else shots
    placed = stay.withColumn("_new", F.lit(0)).unionByName(target.withColumn("_new", F.lit(1)))
    named = unique_names(placed, "file", "_new", "shot_id")
    return named.withColumn("file", F.when(F.col("_new") == 1, F.col("unique_name")).otherwise(F.col("file"))).drop("_new", "unique_name")


def rename(shots: DataFrame, names: DataFrame) -> DataFrame:
    """(shot_id, new_name) applied: a name with a folder part or of an existing file is rejected (``renamed`` false); a
    missing extension is inherited."""
    ext = photo.extension("file")
    given = F.when(photo.extension("new_name") == "", F.concat("new_name", F.when(ext == "", F.lit("")).otherwise(F.concat(F.lit("."), ext)))).otherwise(F.col("new_name"))
    parent = F.expr("substring(file, 1, length(file) - length(substring_index(file, '/', -1)))")
    wanted = shots.join(names, "shot_id").withColumn("_target", F.concat(parent, given))
    taken = shots.select(F.col("file").alias("_target"), F.lit(True).alias("_taken"))
    ok = wanted.join(taken, "_target", "left").select("shot_id", "_target", (F.col("_taken").isNull() & ~F.contains("new_name", F.lit("/"))).alias("renamed"))
    return shots.join(ok, "shot_id", "left").withColumn("file", F.when(F.col("renamed"), F.col("_target")).otherwise(F.col("file"))).withColumn("renamed", F.coalesce("renamed", F.lit(False))).drop("_target")


def to_evict(cache: DataFrame, most: int) -> DataFrame:
    """The oldest files over the limit plus 5 % of it; none at or under the limit."""
    n = cache.count()
    if n <= most:
        return cache.limit(0)
    return cache.orderBy("mtime", "file").limit(n - most + most * 5 // 100)


# ---- parameters


def masked_merge(target: DataFrame, source: DataFrame, mask: DataFrame, key: str, fields: list[str], add: tuple[str, ...] = ()) -> DataFrame:
    """Fields of ``target`` replaced by ``source`` where the mask's field is set; fields in ``add`` are added instead."""
    s = source.select(key, *[F.col(f).alias(f"_s_{f}") for f in fields])
    m = mask.select(key, *[F.col(f).alias(f"_m_{f}") for f in fields])
    new = {f: F.when(F.coalesce(f"_m_{f}", F.lit(False)), F.col(f) + F.col(f"_s_{f}") if f in add else F.col(f"_s_{f}")).otherwise(F.col(f)) for f in fields}
    return target.join(s, key, "left").join(m, key, "left").withColumns(new).select(*target.columns)


def uniform_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """One row: whether all rows agree on each field (nulls count as a value); true for an empty table."""
    agree = lambda f: (F.coalesce(F.min(f) == F.max(f), F.lit(True))) & ((F.count(f) == 0) | (F.count(f) == F.count("*")))
    return rows.agg(*[agree(f).alias(f) for f in fields])


def paste_groups(targets: DataFrame, source: dict, groups: dict[str, list[str]], ticked: set[str]) -> DataFrame:
    """The fields of the ticked groups set to one source row's values."""
    return targets.withColumns({f: F.lit(source[f]) for g in ticked for f in groups[g]})


def filter_tags(tags: Column, unwanted: tuple[str, ...]) -> Column:
    """A tag map without keys that equal an unwanted one or begin with one that ends in a dot."""
    exact = [k for k in unwanted if not k.endswith(".")]
    starts = [k for k in unwanted if k.endswith(".")]
    drop = lambda k: reduce(lambda a, b: a | b, [F.startswith(k, F.lit(s)) for s in starts], k.isin(*exact) if exact else F.lit(False))
    return F.map_filter(tags, lambda k, v: ~drop(k))


def overwrite_tags(tags: Column, edits: Column) -> Column:
    """Tags with edits on top."""
    kept = F.map_filter(tags, lambda k, v: ~F.map_contains_key(edits, k))
    return F.map_concat(kept, edits)
