"""The queries of this subpackage's problems, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwater.llm import encoding, frequencies, grouping, lookalikes, mixing, neardup, packing, survivors, themes
from headwater.plans.lineage import cut
from headwater.sources.tables import table

TEXT = ["Title", "Snippet"]
SIMILAR = 0.65


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return grouping.connected_groups(grouping.valid_links(table(spark, d, "duplicate_pairs")))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.duplicate_groups(table(spark, d, "duplicate_pairs"))


def _survivors(spark: SparkSession, d: str, prior: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "duplicate_groups"), table(spark, d, "clean"), table(spark, d, "feeds"), prior)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d, "strict").select("DupGroupID", F.col("snippet_row_id").cast("long"), F.col("url_row_id").cast("long"))


def p3_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d, "votes")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "clean"), "row_id", *TEXT).select("row_id", "field")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "clean"), "row_id", *TEXT)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_pairs(table(spark, d, "clean"), "row_id", TEXT, SIMILAR)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicate_groups(table(spark, d, "clean"), "row_id", TEXT, SIMILAR)


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    return frequencies.term_frequencies(table(spark, d, "clean"), "Snippet", table(spark, d, "cluster_top_terms"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_terms(spark, d).where("mark != 'useful'").select("term")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    assigned = themes.themes(table(spark, d, "clean"), "row_id", TEXT)
    return themes.same_theme(assigned, table(spark, d, "theme_probe"), "row_id")


def p7_themes(spark: SparkSession, d: str) -> DataFrame:
    posts = table(spark, d, "clean")
    model = themes.theme_model(posts, "row_id", TEXT)
    return themes.theme_report(themes.themes(posts, "row_id", TEXT, model=model), "row_id", model)


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_packed(spark, d).where("pieces > 1 and piece = 0").select("doc_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Of every document how its tokens lie in containers; all containers hold 1,024 at most."""
    packed = cut(p8_packed(spark, d))
    most = packed.groupBy("container").agg(F.sum("tokens").alias("held")).agg(F.max("held")).first()[0] or 0
    pieces = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
    return pieces.withColumn("fits", F.lit(most <= packing.CAPACITY))


def p9_reached(spark: SparkSession, d: str) -> DataFrame:
    """Of every target source whether it falls short, and whether its tokens come within one document of what was wanted, or to all there may be."""
    documents = table(spark, d, "documents")
    shares = mixing.mix(documents, table(spark, d, "mix_targets"))[1]
    sized = mixing.sized_documents(documents)
    largest = sized.groupBy("source").agg(F.max("tokens").alias("largest"))
    rated = shares.join(largest, "source", "left")
    wanted = F.when(F.col("short"), F.col("available") * F.col("max_repeats")).otherwise(F.col("target_share") * (sized.agg(F.sum("tokens")).first()[0] or 0))
    near = F.abs(F.col("tokens") - wanted) <= F.when(F.col("short"), 0).otherwise(F.coalesce("largest", F.lit(0)))
    return rated.select("source", "available", "documents", "short", near.alias("on_target"), (F.col("repeats") <= F.col("max_repeats")).alias("within_repeats"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].where("short").select("source")


def p9_mixed(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_normalized(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.normalize_look(table(spark, d, "documents").select("doc_id", "text", "lang"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_normalized(spark, d).where("text_one_form != text").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        p2_found, p2_groups, p3_found, p3_survivors, p4_found, p4_restored, p5_found, p5_groups, p6_found, p6_terms, p7_found, p7_themes,
        p8_found, p8_packed, p8_pieces, p9_found, p9_mixed, p9_shares, p9_reached, p10_found, p10_normalized,
    )
    return {f.__name__: f for f in named}


LINKS = """links as (select distinct cast(least(i, j) as bigint) as a, cast(greatest(i, j) as bigint) as b from duplicate_pairs
  where i is not null and j is not null and i <> j and similarity is not null and lower(cast(similarity as varchar)) <> 'nan' and similarity >= 0.90),
both_ways as (select a, b from links union select b, a from links),
reach as (select a as row_id, a as other from both_ways union select reach.row_id, both_ways.b from reach join both_ways on reach.other = both_ways.a),
found as (select row_id, min(other) as group_id from reach group by row_id)"""

# the tokenizer's letters and white space, as RE2 writes them
TOKENS = (
    r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"
)

TERMS = r"""w as (select row_id, regexp_extract_all(lower(Snippet), '[\p{L}\p{N}]+') as ws from clean),
e as (select distinct trim(regexp_replace(x, '\s+', ' ', 'g')) as term from (select unnest(string_split(lower(TopTerms), ',')) as x from cluster_top_terms)),
u as (select row_id, unnest(ws) as term from w),
b as (select row_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as term from w where len(ws) > 1),
c as (select term, count(*) as occurrences, count(distinct row_id) as records from u group by term
  union all select term, count(*), count(distinct row_id) from b where term in (select term from e) group by term),
t as (select count(*) as total from clean),
f as (select coalesce(e.term, c.term) as term, coalesce(occurrences, 0) as occurrences, coalesce(records, 0) as records
  from c full join e on c.term = e.term where coalesce(e.term, c.term) <> '')"""


# all pairs by the words each set shares among its rarest ones
SIMILAR_SETS = r"""w as (select row_id, list_distinct(regexp_extract_all(lower(coalesce(Title, '') || ' ' || coalesce(Snippet, '')), '[\p{L}\p{N}]+')) as ws from clean),
s as (select row_id, ws, len(ws) as n from w where len(ws) >= 20),
u as (select row_id, n, unnest(ws) as word from s),
f as (select word, count(*) as df from u group by word),
r as (select row_id, n, word, row_number() over (partition by row_id order by df, word) as k from u join f using (word)),
p as (select row_id, n, word from r where k <= n - ceil(13 * n / 20.0) + 1),
c as (select distinct a.row_id as i, b.row_id as j from p a join p b on a.word = b.word and a.row_id < b.row_id and 20 * least(a.n, b.n) >= 13 * greatest(a.n, b.n)),
m as (select i, j, a.n as n, b.n as o, len(list_intersect(a.ws, b.ws)) as common from c join s a on i = a.row_id join s b on j = b.row_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"with {SIMILAR_SETS} select i, j from m where 20 * common >= 13 * (n + o - common)",
        "p8_pieces": f"""with t as (select doc_id, coalesce({TOKENS}, 0) as tokens from documents)
select doc_id, cast(greatest(ceil(tokens / 1024.0), 1) as bigint) as pieces, cast(tokens as bigint) as tokens, cast(least(tokens, 1024) as bigint) as largest, true as fits from t""",
        "p9_reached": f"""with s as (select source, sum({TOKENS}) as available, count(*) as documents from documents group by source), a as (select sum({TOKENS}) as total from documents)
select m.source, cast(coalesce(available, 0) as bigint) as available, cast(coalesce(documents, 0) as bigint) as documents, coalesce(available, 0) * max_repeats < target_share * total as short,
  true as on_target, true as within_repeats from mix_targets m left join s on m.source = s.source, a""",
        "p2_found": f"with recursive {LINKS} select row_id, group_id from found",
        "p2_groups": f'with recursive {LINKS} select row_id, group_id as "DupGroupID", count(*) over (partition by group_id) as members from found',
        "p6_found": f"with {TERMS} select term from f, t where records < 3 or records > 0.1 * total",
        "p6_terms": f"""with {TERMS} select term, cast(occurrences as bigint) as occurrences, cast(records as bigint) as records,
  records / cast(total as double) as share, case when records < 3 then 'rare' when records > 0.1 * total then 'common' else 'useful' end as mark from f, t""",
        "p8_found": f"select doc_id from documents where {TOKENS} > 1024",
        "p9_found": f"""with s as (select source, sum({TOKENS}) as available from documents group by source), a as (select sum({TOKENS}) as total from documents)
select m.source from mix_targets m left join s on m.source = s.source, a where coalesce(available, 0) * max_repeats < target_share * total""",
    }
