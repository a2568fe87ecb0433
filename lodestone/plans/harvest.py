"""Work lists, counts and orders of a harvest, and texts and times that it mends."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import dates as D
from lodestone.functions import text as T
from lodestone.operators import harvest as H
from lodestone.plans.forms import COLLECTED, form, glue
from lodestone.plans.views import POSTS, posts
from lodestone.session import table

PAGE = 50


def answers(spark, sf_dir):
    """Answers with and without a model's end marks; a mark of signs counts only between letters, so at the very end it stays."""
    k = F.col("page_id")
    said = form("page_id", [glue("It is ", k, ". MODE END."), glue("It is ", k, " end of response"), glue("It is ", k, "..END_OF_TURN"), glue("It is ", k, "... "), glue("It is ", k, ".<|im_end|>"), glue("MODE END ", k)])
    return table(spark, sf_dir, "pages").select("page_id", T.answer(said).alias("answer"))


def clock_times(spark, sf_dir):
    k = F.col("page_id")
    raw = form("page_id", [glue("at ", 1 + k % 11, ":30 AM"), glue(1 + k % 11, ":05 pm"), "12:00 AM", "12:00 PM", "12:01PM", "May 3 at 4:05 PM", "yesterday", None])
    return table(spark, sf_dir, "pages").select("page_id", D.from_clock(raw, F.lit(COLLECTED)).alias("at"))


def media(spark, sf_dir):
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id", "url", F.when(k % 3 == 0, 1).otherwise(4).alias("media_type"), F.when(k % 5 == 0, "").otherwise(F.col("url")).alias("original_url"),
        F.when(k % 2 == 0, "Title").otherwise("").alias("embed_title"), F.when(k % 7 == 0, "i.png").otherwise("").alias("og_image"))


def link_worklist(spark, sf_dir):
    return H.to_enrich(media(spark, sf_dir)).select("page_id", "original_url")


def link_worklist_all(spark, sf_dir):
    return H.to_enrich(media(spark, sf_dir), overwrite=True).select("page_id", "original_url")


def harvest_totals(spark, sf_dir):
    return H.totals(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 4 != 0, F.col("text")).alias("said")), "said")


def harvest_provenance(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("url"), F.when(F.col("event_id") % 3 == 0, "").otherwise(F.col("event_type")).alias("handle"))
    return H.provenance(events, ["url", "handle"])


def backfill_totals(spark, sf_dir):
    """Turns of conversations as chunks: every fifth is empty, and of the others every third is known."""
    new = F.when((F.col("conv_id") + F.col("turn")) % 5 != 0, F.sha2("text", 256))
    old = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, F.sha2("text", 256)).otherwise("")
    return H.backfill(table(spark, sf_dir, "conversations").select("conv_id", old.alias("old"), new.alias("new")), "conv_id", "old", "new")


def export_order(spark, sf_dir):
    """The first rows of an export."""
    return H.by_time(posts(spark, sf_dir).select("id", F.when(F.col("id") % 40 != 0, F.col("created_at")).alias("at")), "at", "id").select("id").limit(PAGE)


def harvested_keys(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("url").distinct().orderBy("url").limit(PAGE)


def collated_keys(spark, sf_dir):
    """Every word of the documents in the order of a locale: its place among those of its language and length. By bytes é follows z, here e."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return words.withColumn("place", F.row_number().over(H.in_order("word", ["lang", F.length("word")])).cast("long"))


def media_first(spark, sf_dir):
    return H.hinted_first(media(spark, sf_dir), F.col("media_type") == 1, "page_id").select("page_id").limit(PAGE)


QUERIES = {
    "answers": answers, "clock_times": clock_times, "link_worklist": link_worklist, "link_worklist_all": link_worklist_all, "harvest_totals": harvest_totals, "harvest_provenance": harvest_provenance,
    "backfill_totals": backfill_totals, "export_order": export_order, "harvested_keys": harvested_keys, "collated_keys": collated_keys, "media_first": media_first,
}

_DAY = "epoch(timestamp '2024-03-05')::bigint"
_LINKS = "select page_id, url as original_url from pages where page_id % 3 <> 0 and page_id % 5 <> 0 and url <> ''"
ORACLE_SQL = {
    "answers": """select page_id, case page_id % 6 when 0 then 'It is ' || page_id when 1 then 'It is ' || page_id when 2 then 'It is ' || page_id when 3 then 'It is ' || page_id || '.' when 4 then 'It is ' || page_id || '.<|im_end|>'
        else 'MODE END ' || page_id end as answer from pages""",
    "clock_times": f"""select page_id, {_DAY} + case page_id % 8 when 0 then (1 + page_id % 11) * 3600 + 1800 when 1 then (13 + page_id % 11) * 3600 + 300 - 86400 when 2 then 0 when 3 then 43200 when 4 then 43260 - 86400 end as at from pages""",
    "link_worklist": f"{_LINKS} and page_id % 2 <> 0 and page_id % 7 <> 0",
    "link_worklist_all": _LINKS,
    "harvest_totals": "select count(*) as items, count(*) filter (doc_id % 4 <> 0 and length(text) > 0) as with_text from documents",
    "harvest_provenance": "select 'url' as field, event_type as origin, count(*) as n from events group by 2 union all select 'handle', event_type, count(*) from events where event_id % 3 <> 0 group by 2",
    "backfill_totals": """with c as (select conv_id, (conv_id + turn) % 5 = 0 as empty, (conv_id + turn) % 3 = 0 as known from conversations)
        select count(*) filter (not empty and not known) as embedded, count(distinct conv_id) filter (not empty and not known) as posts_touched, count(*) filter (known and not empty) as skipped_hash, count(*) filter (empty) as skipped_empty from c""",
    "export_order": f"with {POSTS} select id from posts order by case when id % 40 <> 0 then created_at end nulls first, id limit {PAGE}",
    "harvested_keys": f"select distinct url from pages order by url limit {PAGE}",
    "collated_keys": "with w as (select distinct lang, unnest(regexp_extract_all(text, '\\p{L}+')) as word from documents) select lang, word, row_number() over (partition by lang, length(word) order by word collate en_us, word) as place from w",
    "media_first": f"select page_id from pages order by page_id % 3 <> 0, page_id limit {PAGE}",
}
