"""Queries on training text, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernbrand.llm import abuse, leaks, mixing, percentiles


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


QUANTILES = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def _plain(spelling: str, names: list[str]) -> Column:
    """One spelling of a name, Unknown for what is missing or none of the names."""
    text = F.initcap(F.lower(F.trim(F.col(spelling))))
    return F.when(text.isin(*names), text).otherwise("Unknown")


def _fire_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct results, long: ``result_id``, ``cause``, ``season``, ``measure``, ``value``, ``month``."""
    causes = _read(spark, sf_dir, "ignition", "ignition_id", "cause", "season").where("ignition_id is not null").select(
        "ignition_id", _plain("cause", ["Lightning", "Human"]).alias("cause"), _plain("season", ["Spring", "Summer", "Fall", "Winter"]).alias("season"))
    known = causes.groupBy("ignition_id").agg(F.min(F.struct("cause", "season")).alias("k")).select("ignition_id", "k.cause", "k.season")
    results = _read(spark, sf_dir, "fire_result", "result_id", "ignition_id", "final_area_ha", "final_perimeter_m", "finished_at").distinct()
    joined = results.join(known, "ignition_id", "left").fillna("Unknown", ["cause", "season"])
    measures = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("final_area_ha", "final_perimeter_m")])
    return joined.select("cause", "season", F.date_format("finished_at", "yyyy-MM").alias("month"), F.explode(measures).alias("m")).select("cause", "season", "month", "m.*")


def p7_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.radix_percentiles(_fire_sizes(spark, sf_dir), ["measure", "cause", "season"], "value", QUANTILES).drop("error_bound")


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles with bounded error from the histograms of separate months, added up."""
    groups = ["measure", "cause", "season"]
    monthly = percentiles.radix_histogram(_fire_sizes(spark, sf_dir), [*groups, "month"], "value")
    return percentiles.histogram_percentiles(percentiles.merge_histograms(monthly, groups), groups, QUANTILES)


def p7_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _combined(spark, sf_dir)
    return out.select("measure", "cause", "season", "q", "n", F.round("value", 9).alias("value"), F.round("error_bound", 9).alias("error_bound"))


def p7_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each combined percentile is within its bound of the exact one."""
    keys = ["measure", "cause", "season", "q", "n"]
    exact = p7_percentiles(spark, sf_dir).withColumnRenamed("value", "exact")
    both = _combined(spark, sf_dir).join(exact, keys)
    return both.select(*keys, (F.abs(F.col("value") - F.col("exact")) <= F.col("error_bound") * (1 + 1e-9)).alias("within_bound"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "eval_item"))


def p8_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_sides(_read(spark, sf_dir, "documents", "doc_id", "text"), _read(spark, sf_dir, "eval_item"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(p8_found(spark, sf_dir))


def _mixes(spark: SparkSession, sf_dir: str, total: str | None = None) -> tuple[DataFrame, DataFrame]:
    return mixing.make_mixes(_read(spark, sf_dir, "documents", "doc_id", "source", "text"), _read(spark, sf_dir, "mix_target"), total)


def _by_chars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.make_mixes(_read(spark, sf_dir, "documents", "doc_id", "source", "n_chars"), _read(spark, sf_dir, "mix_target"), mixing.ALL, size_col="n_chars")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixes(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixes(spark, sf_dir)[1]


def p9_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of mixes as large as their sources, where small sources are clamped and others get what they lack."""
    return _mixes(spark, sf_dir, mixing.ALL)[1]


def p9_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clamped mixes by characters, which SQL can count."""
    return _by_chars(spark, sf_dir)[0].withColumnRenamed("n_tokens", "n_chars")


def p9_chars_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = _by_chars(spark, sf_dir)[1]
    return shares.select("mix_name", "source", F.round("actual_share", 9).alias("actual_share"), F.col("tokens").alias("chars"), "documents", "most_copies")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.score_documents(_read(spark, sf_dir, "documents", "doc_id", "text", "source"), _read(spark, sf_dir, "abuse_label", "snippet", "category"), ["source"])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).where(F.col("abuse_score") >= abuse.CASE).select("doc_id").distinct()


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, and what it is nearest to."""
    return _scored(spark, sf_dir).select("doc_id", F.round("abuse_score", 6).alias("abuse_score"), "abuse_kind", "nearest_example")


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.source_rates(_scored(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p7_percentiles": p7_percentiles, "p7_combined": p7_combined, "p7_bounded": p7_bounded, "p8_found": p8_found, "p8_sides": p8_sides, "p8_items": p8_items, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_clamped": p9_clamped, "p9_chars": p9_chars, "p9_chars_shares": p9_chars_shares, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}


_NAMES = """case when lower(trim({c})) in ({names}) then upper(substr(trim({c}), 1, 1)) || lower(substr(trim({c}), 2)) else 'Unknown' end"""
_CAUSE, _SEASON = _NAMES.format(c="cause", names="'lightning', 'human'"), _NAMES.format(c="season", names="'spring', 'summer', 'fall', 'winter'")
_EXACT = f"""
        with i as (select ignition_id, min({{'cause': {_CAUSE}, 'season': {_SEASON}}}) k from ignition where ignition_id is not null group by 1),
        r as (select distinct result_id, ignition_id, final_area_ha, final_perimeter_m, finished_at from fire_result),
        j as (select coalesce(k.cause, 'Unknown') cause, coalesce(k.season, 'Unknown') season, final_area_ha, final_perimeter_m from r left join i using (ignition_id)),
        v as (select 'final_area_ha' measure, cause, season, final_area_ha + 0e0 as value from j union all
              select 'final_perimeter_m', cause, season, final_perimeter_m + 0e0 from j),
        o as (select *, row_number() over (partition by measure, cause, season order by value) rk, count(*) over (partition by measure, cause, season) n
              from v where value is not null and not isnan(value)),
        q as (select unnest([{', '.join(f'{q}e0' for q in QUANTILES)}]) q)
        select measure, cause, season, q, n, value from o, q where rk = greatest(1, ceil(round(q * n, 9)))::bigint"""
# A bucket holds the values of one sign and exponent with the same 15 leading bits of the fraction.
_COMBINED = f"""with x as ({_EXACT}), e as (select *, case when value = 0 then 0 else power(2e0, floor(log2(abs(value))) - 15) end w from x),
    b as (select *, case when value = 0 then 0 else floor(abs(value) / w) * w end low from e)
    select measure, cause, season, q, n, round(sign(value) * (low + low + w * (1 - power(2e0, -37))) / 2, 9) as value, round(w * (1 - power(2e0, -37)) / 2, 9) error_bound from b"""


_TEXT = "regexp_replace(coalesce({}, ''), '[^A-Za-z0-9]+', ' ', 'g')"
_RUNS = """select {id}, list_slice(w, i, i + 19) r from (
    select {id}, w, unnest(range(1, len(w) - 18)) i from (select {id}, string_split(lower(trim({text})), ' ') w from {table}))"""
_SIDES = " union all ".join(f"select distinct item_id, '{side}' side, r from ({_RUNS.format(id='item_id', text=_TEXT.format(side), table='eval_item')})" for side in ("prompt", "answer"))
_ITEMS = " union ".join(f"select item_id, r from ({_RUNS.format(id='item_id', text=_TEXT.format(side), table='eval_item')})" for side in ("prompt", "answer"))
_LEAKS = f"""with items as ({_ITEMS}), docs as ({_RUNS.format(id='doc_id', text=_TEXT.format('text'), table='documents')})
    select distinct doc_id, item_id from docs join items using (r)"""


_SIDE_LEAKS = f"""with items as ({_SIDES}), docs as ({_RUNS.format(id='doc_id', text=_TEXT.format('text'), table='documents')})
    select distinct doc_id, item_id, side from docs join items using (r)"""


# Water-filling in closed form: sources in the order of cap over weight; the level at which the rest can hold the rest of the total.
_CHARS = """with h as (select source, sum(greatest(coalesce(n_chars, 0), 0)) n from documents where source is not null group by 1),
    t as (select distinct mix_name, source, greatest(coalesce(target_share, 0), 0) w, greatest(coalesce(max_repeats, 0), 0) m from mix_target where mix_name is not null and source is not null),
    c as (select t.*, coalesce(n, 0)::double n, coalesce(n, 0)::double * m cap from t left join h using (source)),
    s as (select *, sum(n) filter (where w > 0) over (partition by mix_name) total, row_number() over (partition by mix_name, w > 0 order by case when w > 0 then cap / w end, source) i from c),
    k as (select *, sum(cap) over a - cap below, sum(w) over a - w lighter, sum(w) over (partition by mix_name, w > 0) weight from s window a as (partition by mix_name, w > 0 order by i)),
    l as (select mix_name, arg_min((total - below) / (weight - lighter), i) filter (where (total - below) / (weight - lighter) * w <= cap) level from k where w > 0 group by 1),
    a as (select k.*, case when w = 0 then 0 when level is null then cap else least(cap, level * w) end amount from k left join l using (mix_name)),
    p as (select mix_name, source, m, least(case when n > 0 then floor(amount / n) else 0 end, m)::int whole, n, amount from a),
    q as (select mix_name, source, whole, case when whole < m then amount - whole * n else 0 end rest from p),
    d as (select doc_id, source, greatest(coalesce(n_chars, 0), 0)::bigint n_chars, ('0x' || substr(md5('0:' || doc_id), 1, 15))::bigint o from documents),
    o as (select d.*, sum(n_chars) over (partition by source order by o, doc_id)::double upto from d),
    x as (select mix_name, doc_id, source, n_chars, whole + case when rest > 0 and (upto <= rest or (upto - n_chars <= rest and upto - rest < rest - upto + n_chars)) then 1 else 0 end copies from o join q using (source))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p7_percentiles": _EXACT, "p7_combined": _COMBINED, "p7_bounded": f"select measure, cause, season, q, n, true within_bound from ({_EXACT})",
        "p9_chars": f"{_CHARS} select mix_name, doc_id, source, n_chars, copies from x where copies > 0",
        "p9_chars_shares": f"""{_CHARS}, g as (select mix_name, source, sum(n_chars * copies)::bigint chars, count(*) documents, max(copies) most_copies from x where copies > 0 group by 1, 2)
            select mix_name, source, round(coalesce(chars, 0) / sum(coalesce(chars, 0)) over (partition by mix_name), 9) actual_share, coalesce(chars, 0)::bigint chars, coalesce(documents, 0) documents, coalesce(most_copies, 0) most_copies from t left join g using (mix_name, source)""",
        "p8_found": _LEAKS, "p8_sides": _SIDE_LEAKS, "p8_items": f"select item_id, count(distinct doc_id) n_documents from ({_LEAKS}) group by item_id"}
