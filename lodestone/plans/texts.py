"""Words, languages, tags, URLs, pages, chunks and embedding work lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import stems
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import chunks as C
from lodestone.operators import htmltags, linkify, wordcloud
from lodestone.plans.views import POSTS, post_slug, posts, public_posts
from lodestone.session import table

MODEL = "base-3"


def unigrams(spark, sf_dir):
    return wordcloud.unigrams(public_posts(spark, sf_dir))


def bigrams(spark, sf_dir):
    return wordcloud.bigrams(public_posts(spark, sf_dir)).where(f"n >= {wordcloud.PAIR}")


def cloud(spark, sf_dir):
    return wordcloud.cloud(public_posts(spark, sf_dir))


def word_stems(spark, sf_dir):
    """Every word of the public posts, how often it occurs, and its stem."""
    words = wordcloud.counted(public_posts(spark, sf_dir), T.words(F.col("content_text")))
    return words.select(F.col("term").alias("word"), "n", stems.stem(F.col("term")).alias("stem"))


def stem_cloud(spark, sf_dir):
    return wordcloud.cloud(public_posts(spark, sf_dir), stem=stems.stem)


def languages(spark, sf_dir):
    return posts(spark, sf_dir).select("id", "lang", T.language(F.col("content_text")).alias("detected"))


def language_counts(spark, sf_dir):
    return languages(spark, sf_dir).groupBy("lang", "detected").agg(F.count("*").alias("n"))


def hashtags(spark, sf_dir):
    """Tags of the texts and, as the texts have few, of their sources."""
    tagged = F.concat("content_text", F.lit(" #"), F.col("source_name"), F.lit(" #Été_"), F.col("lang"), F.lit("! #"), F.col("source_name"))
    found = posts(spark, sf_dir).select("id", F.posexplode(F.array_distinct(T.hashtags(tagged))).alias("pos", "tag"))
    return found.select("id", F.col("pos").cast("long").alias("pos"), "tag", F.lower("tag").alias("slug"))


def mentions(spark, sf_dir):
    found = posts(spark, sf_dir).select("id", F.explode(T.mentions(F.col("content_text"))).alias("name"))
    return found.groupBy("id", "name").agg(F.count("*").alias("n"))


def url_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.domain(F.col("url")).alias("domain")).agg(F.count("*").alias("n"))


def url_canonical(spark, sf_dir):
    url = F.concat(F.regexp_replace("url", r"#.*$", ""), F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("eid=7&comment_id=3&x=a%20b&x=2#frag"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", url.alias("long_url"))
    return rows.select("page_id", U.post_key(F.col("long_url")).alias("post_key"), U.same_page(F.col("url")).alias("same_page"), U.first_segment(F.col("url")).alias("segment"))


def status_ids(spark, sf_dir):
    page = table(spark, sf_dir, "pages")
    url = F.concat(F.lit("https://x.com/user"), (F.col("page_id") % 9).cast("string"), F.when(F.col("page_id") % 4 == 0, "/about").otherwise(F.concat(F.lit("/status/"), (F.col("page_id") * 1000003).cast("string"))))
    rows = page.select("page_id", url.alias("u"))
    return rows.select("page_id", U.status_id(F.col("u")).alias("status"), U.status_handle(F.col("u")).alias("handle"), U.tweet_id(F.lit(""), F.lit(None).cast("string"), F.col("u")).alias("source_id"))


def post_ids(spark, sf_dir):
    """Identifiers in all forms of a post's URL, and stable ids of activity rows."""
    k = F.col("page_id")
    forms = F.array(*[F.concat(F.lit(a), k.cast("string"), F.lit(b)) for a, b in (("https://f.example/u/posts/", "?x=1"), ("https://f.example/u/posts/pfbid0", "Ab"), ("https://f.example/p?story_fbid=", "&id=4"), ("https://f.example/photo?set=a&fbid=", ""), ("https://f.example/reel/", "/"), ("https://f.example/u/videos/", "/"), ("https://f.example/u/about/", ""))])
    rows = table(spark, sf_dir, "pages").select("page_id", F.get(forms, (k % 7).cast("int")).alias("u"))
    utime = F.when(F.col("page_id") % 2 == 0, F.col("page_id") + 1_700_000_000)
    raw = F.when(F.col("page_id") % 3 == 0, F.lit("2 d"))
    return rows.select("page_id", U.post_id(F.col("u")).alias("post"), U.activity_id(F.col("u"), utime, raw, F.lit("text")).alias("source_id"))


def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", htmltags.page_title(F.col("html")).alias("title"))


def page_links(spark, sf_dir):
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(htmltags.page_links(F.col("html"))).alias("a"))
    return found.groupBy("page_id", F.col("a.href").alias("href")).agg(F.count("*").alias("n"))


def link_cards(spark, sf_dir):
    """Cards of links, filled in only where they are empty."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, F.lit("kept")).otherwise("").alias("old"), htmltags.cards(F.col("html")).alias("card"))
    return pages.select("page_id", F.coalesce(F.nullif("old", F.lit("")), "card.title").alias("title"), F.col("card.image").alias("image"))


def chunk_documents(spark, sf_dir):
    found = posts(spark, sf_dir).select("id", F.posexplode(C.chunk_array(F.col("content_text"))).alias("chunk_index", "chunk"))
    return found.select("id", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("chunk").cast("long").alias("chars"), F.sha2("chunk", 256).alias("content_hash"))


def embed_hashes(spark, sf_dir):
    rows = posts(spark, sf_dir).select("id", T.embed_input(F.concat(F.lit("Post "), F.col("source_name")), F.col("content_text")).alias("input"))
    return rows.select("id", F.length("input").cast("long").alias("chars"), F.sha2("input", 256).alias("content_hash"))


def embed_worklist(spark, sf_dir):
    """Posts whose input, model or vector isn't what is stored; the stored state is made from the posts' ids."""
    now = embed_hashes(spark, sf_dir).select("id", "content_hash")
    stored = now.where("id % 5 <> 4").select("id", F.when(F.col("id") % 5 == 3, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("id") % 5 == 2, "base-2").otherwise(MODEL).alias("model"), (F.col("id") % 5 != 1).alias("has_vector"))
    return C.to_embed(now, stored, MODEL)


def question_keys(spark, sf_dir):
    text = F.concat(F.lit("  What  IS\n"), F.col("text"), F.lit(" "))
    return table(spark, sf_dir, "benchmark").select("item_id", T.question_key(text).alias("key"))


def linkified(spark, sf_dir):
    rows = posts(spark, sf_dir).select("id", linkify.linkify(F.col("content_text"), {"The": "/p/the"}).alias("html"))
    return rows.select("id", F.length("html").cast("long").alias("chars"), F.regexp_count("html", F.lit("<a href=")).cast("long").alias("links"))


def slugs(spark, sf_dir):
    rows = posts(spark, sf_dir).where("created_at is not null")
    return rows.select("id", post_slug(F.date_format("created_at", "yyyy-MM-dd")).alias("slug"))


QUERIES = {
    "wordcloud_unigrams": unigrams, "wordcloud_bigrams": bigrams, "wordcloud_scaled": cloud, "word_stems": word_stems, "wordcloud_stems": stem_cloud, "language_detect": languages, "language_counts": language_counts, "hashtags": hashtags, "mentions": mentions,
    "url_domain": url_domains, "url_canonical": url_canonical, "tweet_id": status_ids, "post_ids": post_ids, "page_title_extract": page_titles, "page_link_extract": page_links, "link_cards": link_cards,
    "chunk_documents": chunk_documents, "embed_input_hash": embed_hashes, "incremental_embed_worklist": embed_worklist, "question_keys": question_keys, "linkify": linkified, "slugs": slugs,
}

_WORDS = "regexp_extract_all(lower(regexp_replace(content_text, 'https?://\\S+|www\\.\\S+', ' ', 'gi')), '[а-яёa-z]{3,}')"
_STOP = "(" + ", ".join(f"'{w}'" for w in wordcloud.STOP) + ")"
_UNI = f"uni as (select term, count(*) as n from (select unnest({_WORDS}) as term from public_posts) where term not in {_STOP} group by 1)"
_BI = f"""seq as (select id, unnest({_WORDS}) as term, generate_subscripts({_WORDS}, 1) as k from public_posts),
    pairs as (select term as a, lead(term) over (partition by id order by k) as b from seq),
    bi as (select a || ' ' || b as term, count(*) as n from pairs where b is not null and a not in {_STOP} and b not in {_STOP} group by 1)"""
_LANG = f"""case when c + a + o < 1 then 'other' when c + a + o >= 3 and c / (c + a + o) > 0.30 then 'ru' when o >= 1 then 'other'
    when c / (c + a + o) < 0.05 and (len(w) < 3 or len(list_intersect(list_distinct(w), [{", ".join(f"'{x}'" for x in T.ENGLISH_WORDS)}])) >= 2) then 'en' else 'other' end"""
_COUNTS = """letters as (select id, lang, len(regexp_extract_all(content_text, '[\\x{0400}-\\x{04FF}]')) as c, len(regexp_extract_all(content_text, '[A-Za-z]')) as a,
    len(regexp_extract_all(content_text, '\\p{L}')) - len(regexp_extract_all(content_text, '[A-Za-z]')) - len(regexp_extract_all(content_text, '[\\x{0400}-\\x{04FF}]')) as o, regexp_extract_all(lower(content_text), '[a-z'']+') as w from posts)"""
_INPUT = "substr(trim(regexp_replace('Post ' || source_name || chr(10) || chr(10) || content_text, '[\\s\\p{Z}]+', ' ', 'g')), 1, 32000)"
_HASH = f"h as (select id, length({_INPUT}) as chars, sha256({_INPUT}) as content_hash from posts)"
_LAST = lambda mark, n: f"case when contains(seg, {mark}) then length(seg) - (instr(reverse(seg), reverse({mark})) - 1) - {n} else -1 end"
_CUT = f"""case when s + {C.TARGET} >= n then n
    when {_LAST("chr(10) || chr(10)", 2)} >= 0 then s + {C.TARGET // 2} + {_LAST("chr(10) || chr(10)", 2)}
    when greatest({_LAST("'. '", 2)}, {_LAST("'! '", 2)}, {_LAST("'? '", 2)}, {_LAST("'.' || chr(10)", 2)}) >= 0
    then s + {C.TARGET // 2} + greatest({_LAST("'. '", 2)}, {_LAST("'! '", 2)}, {_LAST("'? '", 2)}, {_LAST("'.' || chr(10)", 2)}) + 1 else s + {C.TARGET} end"""
_SEG = f"substr(t, s + {C.TARGET // 2} + 1, least(s + {C.TARGET}, n) - s - {C.TARGET // 2})"
ORACLE_SQL = {
    "wordcloud_unigrams": f"with {POSTS}, {_UNI} select * from uni",
    "wordcloud_bigrams": f"with {POSTS}, {_BI} select * from bi where n >= {wordcloud.PAIR}",
    "wordcloud_scaled": f"""with {POSTS}, {_UNI}, {_BI}, l as (select * from (select * from uni union all select * from bi) order by n desc, term limit {wordcloud.LOOKED_AT * wordcloud.TERMS}),
        t as (select * from l where not contains(term, ' ') or n >= {wordcloud.PAIR} order by n desc, term limit {wordcloud.TERMS}), r as (select min(n) as lo, greatest(max(n) - min(n), 1) as span from t)
        select term, n, (14 + floor((n - lo) / span * 34))::bigint as size, round(0.55::double + 0.45::double * ((n - lo) / span), 6) as opacity from t, r""",
    "language_detect": f"with {POSTS}, {_COUNTS} select id, lang, {_LANG} as detected from letters",
    "language_counts": f"with {POSTS}, {_COUNTS} select lang, {_LANG} as detected, count(*) as n from letters group by 1, 2",
    "hashtags": f"""with {POSTS}, t as (select id, regexp_extract_all(content_text || ' #' || source_name || ' #Été_' || lang || '! #' || source_name, '#([\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}]+)', 1) as l from posts),
        d as (select id, list_filter(l, lambda x, i: list_position(l, x) = i) as l from t) select id, generate_subscripts(l, 1) - 1 as pos, unnest(l) as tag, lower(unnest(l)) as slug from d""",
    "mentions": f"with {POSTS}, m as (select id, unnest(regexp_extract_all(content_text, '@([A-Za-z0-9_]+)', 1)) as name from posts) select id, name, count(*) as n from m group by 1, 2",
    "url_domain": "select regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\\.', '') as domain, count(*) as n from pages group by 1",
    "url_canonical": """with u as (select page_id, url, regexp_extract(url, '^([^?#]*)', 1) as base, regexp_extract(url, '\\?([^#]*)', 1) as query from pages)
        select page_id, base || '?' || case when query <> '' then query || case when contains('&' || query, '&x=') then '' else '&x=a+b' end else 'x=a+b' end as post_key,
        regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(url, '#.*$', '')), '^https?://(www\\.|m\\.)?', ''), '/+\\?', '?'), '/+$', '') as same_page,
        regexp_extract(url, '^[a-z]+://[^/]+/+([^/?#]+)', 1) as segment from u""",
    "tweet_id": """with u as (select page_id, 'https://x.com/user' || (page_id % 9) || case when page_id % 4 = 0 then '/about' else '/status/' || (page_id * 1000003) end as u from pages)
        select page_id, nullif(regexp_extract(u, '/status/(\\d+)', 1), '') as status, case when page_id % 4 <> 0 then 'user' || (page_id % 9) end as handle,
        coalesce(nullif(regexp_extract(u, '/status/(\\d+)', 1), ''), 'tw_' || substr(sha256(u), 1, 16)) as source_id from u""",
    "post_ids": """with p as (select page_id, case page_id % 7 when 1 then 'pfbid0' || page_id || 'Ab' when 6 then null else page_id::varchar end as post from pages)
        select page_id, post, case when page_id % 7 in (0, 2, 3, 4, 5) then post else 'al_' || substr(sha256(case when page_id % 2 = 0 then (page_id + 1700000000) || '|text' when page_id % 3 = 0 then '2 d|text' else 'text' end), 1, 16) end as source_id from p""",
    "page_title_extract": "select page_id, trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')) as title from pages",
    "page_link_extract": "with a as (select page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', '', 'g'), '(?i)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"'']', 1)) as href from pages) select page_id, href, count(*) as n from a group by 1, 2",
    "chunk_documents": f"""with recursive {POSTS}, d as (select id, trim(content_text, ' ' || chr(10) || chr(13) || chr(9)) as t, length(trim(content_text, ' ' || chr(10) || chr(13) || chr(9))) as n from posts),
        w as (select id, 0 as s, t, n, {_SEG.replace("s +", "0 +").replace("- s ", "- 0 ")} as seg from d where n > 0
            union all select id, s2, t, n, {_SEG.replace("s +", "s2 +").replace("- s ", "- s2 ")} from (select id, t, n, greatest(s + 1, e - {C.OVERLAP}) as s2 from (select id, t, n, s, {_CUT} as e from w) where e < n)),
        p as (select id, s, trim(substr(t, s + 1, {_CUT} - s), ' ' || chr(10) || chr(13) || chr(9)) as chunk from w)
        select id, row_number() over (partition by id order by s) - 1 as chunk_index, length(chunk) as chars, sha256(chunk) as content_hash from p where chunk <> ''""",
    "embed_input_hash": f"with {POSTS}, {_HASH} select * from h",
    "incremental_embed_worklist": f"with {POSTS}, {_HASH} select id, content_hash from h where id % 5 in (1, 2, 3, 4)",
    "question_keys": "select item_id, sha256(trim(regexp_replace(lower('  What  IS' || chr(10) || text || ' '), '[\\s\\p{Z}]+', ' ', 'g'))) as key from benchmark",
}
