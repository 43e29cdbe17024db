"""Queries over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import photo
from ..operators import catalog as C
from ..operators import edits as E
from ..operators import match as M
from . import tables as T
from .registry import query, rounded, sql_rounded

SHOTS, FRAMES, QUEUE, EDITS = (T.sql(x) for x in (T.SHOTS, T.FRAMES, T.QUEUE, T.EDITS))
BASE = "regexp_replace(file, '^.*/', '')"

# ---- filters

_SORTED = C.BrowserFilter(ranks=(1, 2, 3, 4), labels=(0, 1, 2, 3), show_trash=False, names="shot_1,,SHOT_2", exif=C.ExifFilter(iso=(400, 3200), fnumber=(2.4, 8.4)))


@query(f"""select shot_id, file, taken, rank, color_label from {SHOTS} where rank in (1, 2, 3, 4) and color_label in (0, 1, 2, 3) and not in_trash
and (contains(upper({BASE}), 'SHOT_1') or contains(upper({BASE}), 'SHOT_2')) and (not exif_valid or (iso between 400 and 3200 and fnumber between 2.4e0 - 1e-8 and 8.4e0 + 1e-8))""")
def catalog_filter_sort(spark, sf_dir):
    rows = C.apply_filter(T.table(spark, sf_dir, T.SHOTS), _SORTED)
    return C.resort(rows, "date").select("shot_id", "file", "taken", "rank", "color_label")


@query(f"select shot_id, file from {SHOTS} where not contains(upper({BASE}), '.NEF') and edited and in_trash")
def catalog_filter_negated_name(spark, sf_dir):
    spec = C.BrowserFilter(names="!=.nef", edited=True, show_not_trash=False)
    return C.apply_filter(T.table(spark, sf_dir, T.SHOTS), spec).select("shot_id", "file")


@query(f"select shot_id, exif_valid from {SHOTS} where filetype in ('nef', 'dng') and expcomp in ('0.00', '0.33') and (not exif_valid or (focal between 20.0e0 - 0.01e0 and 90.0e0 + 0.01e0 and shutter between 0.004e0 - 1e-8 and 0.1e0 + 1e-8))")
def catalog_exif_invalid_rule(spark, sf_dir):
    spec = C.BrowserFilter(exif=C.ExifFilter(filetypes=("nef", "dng"), expcomps=("0.00", "0.33"), focal=(20.0, 90.0), shutter=(0.004, 0.1)))
    return C.apply_filter(T.table(spark, sf_dir, T.SHOTS), spec).select("shot_id", "exif_valid")


@query(f"select count(*) as n from {SHOTS} where recently_saved and color_label = 2 and rank >= 3")
def filtered_selection_count(spark, sf_dir):
    shots = T.table(spark, sf_dir, T.SHOTS)
    rows = C.filtered_selection(shots, shots.where("rank >= 3"), C.BrowserFilter(labels=(2,), recently_saved=True))
    return rows.agg(F.count("*").alias("n"))


# ---- facets, order, originals


@query(f"""select camera, min(fnumber) as min_fnumber, max(fnumber) as max_fnumber, {sql_rounded('min(shutter)', 8)} as min_shutter, {sql_rounded('max(shutter)', 8)} as max_shutter, min(focal) as min_focal, max(focal) as max_focal,
min(iso) filter (iso > 0) as min_iso, max(iso) filter (iso > 0) as max_iso from {SHOTS} group by camera""")
def facet_ranges(spark, sf_dir):
    rows = C.facets(T.table(spark, sf_dir, T.SHOTS), "camera")
    return rows.select("camera", "min_fnumber", "max_fnumber", rounded("min_shutter", 8).alias("min_shutter"), rounded("max_shutter", 8).alias("max_shutter"), "min_focal", "max_focal", "min_iso", "max_iso")


@query(f"""select camera, array_to_string(list_sort(list(distinct filetype)), '|') as filetypes, array_to_string(list_sort(list(distinct lens)), '|') as lenses, array_to_string(list_sort(list(distinct expcomp)), '|') as expcomps from {SHOTS} group by camera""")
def facet_sets(spark, sf_dir):
    rows = C.facets(T.table(spark, sf_dir, T.SHOTS), "camera")
    return rows.select("camera", *[F.array_join(f"{c}_set", "|").alias(f"{c}s") if c != "lens" else F.array_join("lens_set", "|").alias("lenses") for c in ("filetype", "lens", "expcomp")])


_STEM = "lower(regexp_replace(regexp_replace(file, '^.*/', ''), '\\.[^./]*$', ''))"


@query(f"""with k as (select shot_id, folder, {_STEM} as stem, nullif(list_position(['jpg', 'nef'], filetype), 0) as pr from {SHOTS}),
f as (select folder, stem, arg_min(coalesce(pr, -1), shot_id) as first_pr, min(shot_id) as first_id, arg_min(shot_id, (coalesce(pr, 1000000), shot_id)) as best_id from k group by folder, stem)
select shot_id, case when first_pr = -1 then first_id else best_id end as original_id, shot_id = case when first_pr = -1 then first_id else best_id end as is_original from k join f using (folder, stem)""")
def dedupe_original(spark, sf_dir):
    return C.mark_originals(T.table(spark, sf_dir, T.SHOTS), ["jpg", "nef"]).select("shot_id", "original_id", "is_original")


@query(f"select shot_id, lead(shot_id) over w as next_id, lag(shot_id) over w as prev_id from {SHOTS} where not in_trash window w as (partition by folder order by file, shot_id)")
def next_prev_row(spark, sf_dir):
    return C.neighbours(T.table(spark, sf_dir, T.SHOTS).where("not in_trash"), "folder", "file", "shot_id").select("shot_id", "next_id", "prev_id")


@query(f"select shot_id, rank, file from {SHOTS}")
def resort_rank_desc(spark, sf_dir):
    return C.resort(T.table(spark, sf_dir, T.SHOTS), "rank", descending=True).select("shot_id", "rank", "file")


# ---- names


@query(f"""select shot_id, regexp_replace({BASE}, '\\.[^.]*$', '') || '-' || regexp_replace(folder, '^.*/', '') || '_' || case when in_trash then 'x' else cast(rank as varchar) end || '_' || lpad(cast(shot_id as varchar), 6, '0') || '%' as name from {SHOTS}""")
def output_name_template(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS)
    name = photo.output_name(F.col("file"), "%f-%d1_%r_%s6%%", F.col("rank"), F.col("in_trash"), F.col("shot_id"), F.timestamp_seconds("taken"))
    return s.select("shot_id", name.alias("name"))


@query(f"""with k as (select shot_id, camera || '.' || filetype as name, camera, filetype, row_number() over (partition by camera || '.' || filetype order by shot_id) - 1 as k from {SHOTS})
select shot_id, case when k = 0 then name when k < 100 then regexp_replace(name, '\\.[^.]*$', '') || '-' || cast(k as varchar) || '.' || filetype end as unique_name from k""")
def name_collision_suffix(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS).withColumn("name", F.concat("camera", F.lit("."), "filetype"))
    return C.unique_names(s, "name", "shot_id").select("shot_id", "unique_name")


@query(f"""select shot_id, regexp_extract({BASE}, '\\.([^./]*)$', 1) as extension, regexp_replace(file, '\\.[^./]*$', '') as stem, lower(regexp_replace(file, '^.*\\.', '')) as kind, md5(file || cast(size as varchar)) as cache_key, file || '.xmp' as sidecar, regexp_replace(file, '\\.[^./]*$', '') || '.xmp' as sidecar_std from {SHOTS}""")
def path_functions(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS)
    return s.select("shot_id", photo.extension("file").alias("extension"), photo.without_extension("file").alias("stem"), photo.file_type("file").alias("kind"), photo.cache_key("file", "size").alias("cache_key"), photo.sidecar_path("file").alias("sidecar"), photo.sidecar_path("file", True).alias("sidecar_std"))


_EVEN = "case when abs(q * 10 - trunc(q * 10)) = 0.5 then round(q * 10 / 2) * 2 / 10 else round(q, 1) end"


@query(f"""select shot_id, printf('%.1f', fnumber) as aperture, '1/' || cast(round_even(1.0e0 / shutter, 0) as bigint) as shutter_text from {SHOTS} where shutter <= 0.5e0
union all select shot_id, printf('%.1f', fnumber), cast(cast(shutter as bigint) as varchar) from {SHOTS} where shutter > 0.5e0""")
def shutter_format_parse(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS)
    return s.select("shot_id", photo.aperture_text("fnumber").alias("aperture"), photo.shutter_text("shutter").alias("shutter_text"))


@query(f"select shot_id, {sql_rounded('1.0e0 / round_even(1.0e0 / shutter, 0)', 9)} as seconds from {SHOTS}")
def shutter_round_trip(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS)
    return s.select("shot_id", rounded(photo.shutter_seconds(photo.shutter_text("shutter")), 9).alias("seconds"))


@query(f"select shot_id, case when cast(expcomp as double) = 0 then '' else expcomp end as text from {SHOTS}")
def expcomp_format(spark, sf_dir):
    return T.table(spark, sf_dir, T.SHOTS).select("shot_id", photo.expcomp_text(F.col("expcomp").cast("double"), True).alias("text"))


# ---- queue and changes


def _queue_sql(first: str) -> str:
    return f"select entry, seq, row_number() over (order by case when processing then 0 when {first} then 1 else 2 end, seq) - 1 as position from {QUEUE}"


@query(_queue_sql("selected"))
def queue_head(spark, sf_dir):
    return C.head_items(T.table(spark, sf_dir, T.QUEUE), F.col("selected")).select("entry", "seq", F.col("position").cast("bigint").alias("position"))


@query(_queue_sql("not selected"))
def queue_tail(spark, sf_dir):
    return C.tail_items(T.table(spark, sf_dir, T.QUEUE), F.col("selected")).select("entry", "seq", F.col("position").cast("bigint").alias("position"))


@query(f"select entry, seq from {QUEUE} where processing or not selected")
def queue_cancel(spark, sf_dir):
    q = T.table(spark, sf_dir, T.QUEUE)
    return C.cancel_items(q, q.where("selected"), "entry").select("entry", "seq")


@query(f"""with q as (select * from {QUEUE}), e as (select concat('new-', c_custkey) as entry, c_custkey - (select min(c_custkey) from customer) as k from customer), n as (select count(*) as n from e)
select entry, case when processing then seq else seq + n end as seq from q, n union all select entry, 2 + n - 1 - k from e, n""")
def queue_add_head(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    first = F.broadcast(c.agg(F.min("c_custkey").alias("first")))  # one row
    fresh = c.crossJoin(first).select(F.concat(F.lit("new-"), F.col("c_custkey")).alias("entry"), (F.col("c_custkey") - F.col("first")).alias("seq"), F.lit(False).alias("processing"), F.lit(False).alias("selected"))
    return C.add_entries(T.table(spark, sf_dir, T.QUEUE), fresh, head=True).select("entry", "seq")


@query(f"""with a as (select file from {SHOTS} where shot_id % 3 <> 0), b as (select file from {SHOTS} where shot_id % 4 <> 0)
select file, 'removed' as change from (select file from a except select file from b) union all select file, 'added' from (select file from b except select file from a)""")
def listing_diff(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS)
    return C.listing_changes(s.where("shot_id % 3 <> 0"), s.where("shot_id % 4 <> 0"))


@query(f"select shot_id, case when camera = 'Brand#11' then 5 else rank end as rank, case when in_trash then 0 else color_label end as color_label from {SHOTS}")
def rank_label_update(spark, sf_dir):
    s = C.set_where(T.table(spark, sf_dir, T.SHOTS), F.col("camera") == "Brand#11", rank=5)
    return C.set_where(s, F.col("in_trash"), color_label=0).select("shot_id", "rank", "color_label")


@query(f"select camera, count(*) as n from {SHOTS} where not in_trash group by camera")
def empty_trash_counts(spark, sf_dir):
    return C.empty_trash(T.table(spark, sf_dir, T.SHOTS)).groupBy("camera").agg(F.count("*").alias("n"))


@query(f"select count(*) = 0 as is_empty from {SHOTS} where in_trash")
def trash_is_empty(spark, sf_dir):
    return C.trash_is_empty(T.table(spark, sf_dir, T.SHOTS))


@query(f"""with n as (select count(*) as n from {SHOTS}) select shot_id, file from {SHOTS} order by taken, shot_id limit (select n - cast(floor(n / 2) as bigint) + cast(floor(floor(n / 2) * 5 / 100) as bigint) from n)""")
def evict_oldest(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS).select("shot_id", F.lpad(F.col("shot_id").cast("string"), 12, "0").alias("file"), F.col("taken").alias("mtime"), F.col("file").alias("name"))
    return C.to_evict(s, s.count() // 2).select("shot_id", F.col("name").alias("file"))


@query(f"""select s.shot_id, case when s.shot_id % 2 = 0 then s.iso + 100 else s.iso end as iso, case when s.shot_id % 3 = 0 then s.focal * 2 else s.focal end as focal from {SHOTS} s""")
def masked_merge(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS).select("shot_id", "iso", "focal")
    source = s.select("shot_id", F.lit(100).cast(s.schema["iso"].dataType).alias("iso"), (F.col("focal") * 2).alias("focal"))
    mask = s.select("shot_id", (F.col("shot_id") % 2 == 0).alias("iso"), (F.col("shot_id") % 3 == 0).alias("focal"))
    return C.masked_merge(s, source, mask, "shot_id", ["iso", "focal"], add=("iso",))


@query(f"select min(camera) = max(camera) as camera, min(in_trash) = max(in_trash) as in_trash, min(size - size) = max(size - size) as nothing from {SHOTS}")
def uniform_fields(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS).withColumn("nothing", F.col("size") - F.col("size"))
    return C.uniform_fields(s, ["camera", "in_trash", "nothing"])


@query(f"select shot_id, '7' as iso, 'n' as note, lens from {SHOTS}")
def tag_filter(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS)
    tags = F.create_map(F.lit("Exif.Image.Make"), F.col("make"), F.lit("Exif.Thumb.Size"), F.lit("1"), F.lit("Exif.Photo.ISO"), F.col("iso").cast("string"), F.lit("Exif.Photo.Lens"), F.col("lens"))
    kept = C.overwrite_tags(C.filter_tags(tags, ("Exif.Image.Make", "Exif.Thumb.")), F.create_map(F.lit("Exif.Photo.ISO"), F.lit("7"), F.lit("Note"), F.lit("n")))
    rows = s.select("shot_id", kept.alias("t"))
    return rows.where(F.size("t") == 3).select("shot_id", F.col("t")["Exif.Photo.ISO"].alias("iso"), F.col("t")["Note"].alias("note"), F.col("t")["Exif.Photo.Lens"].alias("lens"))


# ---- matching


def _nearest_sql(key: list[str], camera: list[str], weights: dict[str, float]) -> str:
    text = lambda a, f: f"upper({a}.{f})" if f in ("make", "model", "lens") else f"printf('%.2f', cast({a}.{f} as double))"
    same = " and ".join(f"{text('p', f)} = {text('f', f)}" for f in key)
    cam = " and ".join(f"upper(p.{f}) = upper(f.{f})" for f in camera)
    dist = " + ".join(f"{w} * power(log2(p.{f} / f.{f}), 2)" for f, w in weights.items())
    frames = FRAMES
    return f"""with p as (select * from {SHOTS.replace('fnumber', 'aperture') if 'aperture' in weights else SHOTS}), f as (select * from {frames}),
s as (select p.shot_id, arg_min(f.frame_id, (abs(p.ts - f.ts), f.frame_id)) as frame_id from p join f on {same} group by p.shot_id),
n as (select p.shot_id, arg_min(f.frame_id, (sqrt({dist}), f.frame_id)) as frame_id, min(sqrt({dist})) as d from p join f on {cam} where p.shot_id not in (select shot_id from s) group by p.shot_id)
select p.shot_id, s.frame_id is not null as exact, {sql_rounded('coalesce(case when s.frame_id is not null then 0 end, n.d)', 6)} as distance, s.frame_id as by_time from p left join s using (shot_id) left join n using (shot_id)"""


def _matched(rows):
    exact = F.coalesce(F.col("distance") == 0.0, F.lit(False)) & F.col("frame_id").isNotNull()
    return rows.select("shot_id", exact.alias("exact"), rounded("distance", 6).alias("distance"), F.when(exact, F.col("frame_id")).alias("by_time"))


@query(_nearest_sql(["make", "model", "iso", "shutter"], ["make", "model"], {"iso": 1.0, "shutter": 1.0}))
def dark_nearest(spark, sf_dir):
    return _matched(M.dark_frames(T.table(spark, sf_dir, T.SHOTS), T.table(spark, sf_dir, T.FRAMES)))


@query(_nearest_sql(["make", "model", "lens", "focal", "aperture"], ["make", "model", "lens"], {"focal": 1.0, "aperture": 2.0}))
def flat_nearest_weighted(spark, sf_dir):
    shots = T.table(spark, sf_dir, T.SHOTS).withColumnRenamed("fnumber", "aperture")
    return _matched(M.flat_fields(shots, T.table(spark, sf_dir, T.FRAMES)))


@query(f"""with l as (select camera, iso as level_iso, max(size) as white from {SHOTS} where iso % 700 = 0 group by camera, iso)
select s.shot_id, arg_min(l.level_iso, (abs(l.level_iso - (s.iso + 50)), -l.level_iso)) as level_iso, arg_min(l.white, (abs(l.level_iso - (s.iso + 50)), -l.level_iso)) as white from {SHOTS} s left join l on l.camera = s.camera group by s.shot_id""")
def iso_level_nearest(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS)
    levels = s.where("iso % 700 = 0").groupBy("camera", F.col("iso").alias("level_iso")).agg(F.max("size").alias("white"))
    return M.nearest_level(s.withColumn("iso", F.col("iso") + 50), levels, "camera").select("shot_id", "level_iso", "white")


@query(f"""with f as (select camera, focal, min(size) as k, max(fnumber) as a from {SHOTS} where shot_id % 3 = 0 group by camera, focal), s as (select shot_id, camera, focal + 0.5e0 as focal from {SHOTS}),
e as (select s.shot_id, s.focal, arg_max(struct_pack(at := f.focal, k := f.k, a := f.a), f.focal) filter (f.focal <= s.focal) as lo, arg_min(struct_pack(at := f.focal, k := f.k, a := f.a), f.focal) filter (f.focal >= s.focal) as hi from s join f on f.camera = s.camera group by s.shot_id, s.focal),
b as (select shot_id, focal, coalesce(lo, hi) as lo, coalesce(hi, lo) as hi from e)
select s.shot_id, {sql_rounded('lo.k + case when hi.at = lo.at then 0 else (b.focal - lo.at) / (hi.at - lo.at) end * (hi.k - lo.k)')} as k, {sql_rounded('lo.a + case when hi.at = lo.at then 0 else (b.focal - lo.at) / (hi.at - lo.at) end * (hi.a - lo.a)')} as a from s left join b using (shot_id)""")
def bracket_interp(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS)
    f = s.where("shot_id % 3 = 0").groupBy("camera", "focal").agg(F.min("size").alias("k"), F.max("fnumber").alias("a"))
    out = M.bracket(s.withColumn("focal", F.col("focal") + 0.5), f, "camera", "focal", ["k", "a"])
    return out.select("shot_id", rounded("k").alias("k"), rounded("a").alias("a"))


#: serial, iso, f-number, focal and shutter ranges, camera and lens terms, profile
RULES = (
    (1, 0, 100000, 0.0, 99.0, 0.0, 9999.0, 0.0, 99.0, False, "", False, "", "base"),
    (2, 1600, 100000, 0.0, 99.0, 0.0, 9999.0, 0.0, 99.0, False, "", False, "", "noise"),
    (3, 0, 100000, 0.0, 2.9, 0.0, 9999.0, 0.0, 99.0, True, "re:^brand#[12]", False, "", "wide"),
    (4, 0, 100000, 0.0, 99.0, 50.0, 120.0, 0.0, 0.01, True, "BRAND#23", False, "", "tele"),
    (5, 0, 800, 0.0, 99.0, 0.0, 9999.0, 0.0, 99.0, False, "", True, "re:steel|tin", "metal"),
)
PROFILES = (("base", 0.0, 10, None), ("noise", None, 20, "strong"), ("wide", 0.5, None, None), ("tele", None, 40, "weak"), ("metal", 0.9, None, None))
_RULE_COLUMNS = "serial, iso_min, iso_max, fnumber_min, fnumber_max, focal_min, focal_max, shutter_min, shutter_max, camera_enabled, camera_value, lens_enabled, lens_value, profile"


def _values(rows) -> str:
    word = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else repr(v)
    return ", ".join("(" + ", ".join(map(word, r)) + ")" for r in rows)


_TERM = "(not {f}_enabled or case when starts_with({f}_value, 're:') then regexp_matches({f}, '(?i)' || substring({f}_value, 4)) else lower({f}_value) = lower({f}) end)"
_RULES_SQL = f"""select shot_id, serial, profile from {SHOTS} join (select * from (values {_values(RULES)}) t({_RULE_COLUMNS})) r
on iso between iso_min and iso_max and fnumber between fnumber_min and fnumber_max and focal between focal_min and focal_max and shutter between shutter_min and shutter_max and {_TERM.format(f='camera')} and {_TERM.format(f='lens')}"""


def _rules(spark, sf_dir):
    schema = "serial int, iso_min int, iso_max int, fnumber_min double, fnumber_max double, focal_min double, focal_max double, shutter_min double, shutter_max double, camera_enabled boolean, camera_value string, lens_enabled boolean, lens_value string, profile string"
    return M.matching_rules(T.table(spark, sf_dir, T.SHOTS), spark.createDataFrame(list(RULES), schema))


@query(_RULES_SQL)
def rule_join(spark, sf_dir):
    return _rules(spark, sf_dir)


@query(f"""with m as ({_RULES_SQL}), p as (select profile, cast(sharpen as double) as sharpen, denoise, mode from (values {_values(PROFILES)}) t(profile, sharpen, denoise, mode))
select shot_id, arg_max(sharpen, serial) filter (sharpen is not null) as sharpen, arg_max(denoise, serial) filter (denoise is not null) as denoise, arg_max(mode, serial) filter (mode is not null) as mode from m join p using (profile) group by shot_id""")
def rule_layer_merge(spark, sf_dir):
    profiles = spark.createDataFrame(list(PROFILES), "profile string, sharpen double, denoise int, mode string")
    return M.layered_profile(_rules(spark, sf_dir), profiles, ["sharpen", "denoise", "mode"])


# ---- edits

ACTIONS = (("click", 1), ("view", 2), ("purchase", 12), ("scroll", 16))
_ACTIONS_SQL = f"(select * from (values {_values(ACTIONS)}) t(event, mask))"


def _masked(spark, sf_dir):
    return E.stage_masks(T.table(spark, sf_dir, T.EDITS), spark.createDataFrame(list(ACTIONS), "event string, mask int"))


@query(f"select image, seq, event, coalesce(mask, 0) as mask from {EDITS} left join {_ACTIONS_SQL} using (event)")
def event_mask_join(spark, sf_dir):
    return _masked(spark, sf_dir).select("image", "seq", "event", "mask")


@query(f"select image, bit_or(coalesce(mask, 0)) as mask, {sql_rounded('arg_max(params, seq)')} as params, max(seq) as last_seq, count(*) as n_edits from {EDITS} left join {_ACTIONS_SQL} using (event) group by image")
def event_coalesce(spark, sf_dir):
    return E.coalesce_edits(_masked(spark, sf_dir)).select("image", "mask", rounded("params").alias("params"), "last_seq", "n_edits")


@query(f"select image, seq, event from (select *, lead(event) over (partition by image order by seq) as after from {EDITS}) where after is null or after <> event")
def history_collapse(spark, sf_dir):
    return E.collapse_history(T.table(spark, sf_dir, T.EDITS)).select("image", "seq", "event")


@query(f"""select folder, file, seq, row_number() over (partition by folder order by priority desc, upgrade, seq) as position from (select camera as folder, file, shot_id as seq, rank = 5 as priority, edited as upgrade from {SHOTS} where exif_valid)""")
def job_order(spark, sf_dir):
    s = T.table(spark, sf_dir, T.SHOTS).where("exif_valid").select(F.col("camera").alias("folder"), "file", F.col("shot_id").alias("seq"), (F.col("rank") == 5).alias("priority"), F.col("edited").alias("upgrade"))
    return E.job_order(s, "folder").select("folder", "file", "seq", "position")


@query(f"select image, event, last_access from (select image, event, max(seq) as last_access, row_number() over (partition by image order by max(seq) desc) as k from {EDITS} group by image, event) where k <= 3")
def lru_keep(spark, sf_dir):
    return E.lru_keep(T.table(spark, sf_dir, T.EDITS), "image", "event", "seq", 3)


# ---- files

_MOVED = f"""with s as (select shot_id, file, shot_id % 7 = 3 as chosen from {SHOTS}),
t as (select shot_id, file, 0 as new from s {{stay}} union all select shot_id, '/sorted/' || regexp_replace(file, '^.*/', ''), 1 from s where chosen),
k as (select *, row_number() over (partition by file order by new, shot_id) - 1 as k from t)
select shot_id, case when new = 0 or k = 0 then file when k < 100 then regexp_replace(file, '\\.[^.]*$', '') || '-' || cast(k as varchar) || regexp_extract(file, '\\.[^.]*$') end as file from k"""


def _placed(spark, sf_dir, move: bool):
    shots = T.table(spark, sf_dir, T.SHOTS)
    return C.copy_or_move(shots, shots.where("shot_id % 7 = 3"), "/sorted/", move).select("shot_id", "file")


@query(_MOVED.format(stay=""))
def copy_files(spark, sf_dir):
    return _placed(spark, sf_dir, False)


@query(_MOVED.format(stay="where not chosen"))
def move_files(spark, sf_dir):
    return _placed(spark, sf_dir, True)


@query(f"""with s as (select shot_id, file, regexp_extract(file, '^.*/') as folder, regexp_extract(file, '\\.[^.]*$') as ext from {SHOTS}),
w as (select *, folder || case shot_id % 20 when 0 then 'new ' || cast(shot_id as varchar) || ext when 5 then 'tiff ' || cast(shot_id as varchar) || '.tif' when 15 then regexp_replace(file, '^.*/', '') end as wanted from s),
r as (select *, wanted is not null and wanted not in (select file from {SHOTS}) as renamed from w)
select shot_id, case when renamed then wanted else file end as file, renamed from r""")
def rename_files(spark, sf_dir):
    """New names without an extension inherit it; a folder in the name and names that exist are rejected."""
    shots, n = T.table(spark, sf_dir, T.SHOTS), F.col("shot_id") % 20
    number = F.col("shot_id").cast("string")
    name = F.when(n == 0, F.concat(F.lit("new "), number)).when(n == 5, F.concat(F.lit("tiff "), number, F.lit(".tif"))).when(n == 10, F.concat(F.lit("other/"), number)).when(n == 15, F.substring_index("file", "/", -1))
    names = shots.where(n.isin(0, 5, 10, 15)).select("shot_id", name.alias("new_name"))
    return C.rename(shots, names).select("shot_id", "file", "renamed")
