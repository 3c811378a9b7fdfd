"""Every operator as a query over the driver's tables, and the same in DuckDB SQL where it can be said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxlake.functions import scoring, segmentation, text
from voxlake.operators import maintenance as mt
from voxlake.operators import relational as rel
from voxlake.operators import sequence as seq
from voxlake.operators import signal as sig
from voxlake.sources import tables as src
from voxlake.streaming import running

from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
c, lit = F.col, F.lit
NOW = "2024-01-15 12:00:00"
ACCENTS = "áàâäãéèêëíìîïóòôöõúùûüçñÁÉÍÓÚÑÜÖÄ"
PLAIN = "aaaaaeeeeiiiiooooouuuucnAEIOUNUOA"
TONES_OFF = dict(zip(ACCENTS, PLAIN, strict=True))


def query(name: str, sql: str | None = None):
    """Registers a function of (v, d): v gives a view or table by name."""

    def put(f):
        QUERIES[name] = lambda spark, d: f(lambda n: view(spark, d, n))
        if sql is not None:
            SQL[name] = with_views(sql)
        return f

    return put


def plain(col):
    return F.translate(col, ACCENTS, PLAIN)


# sources and sinks


@query("s1_table_scan", "SELECT r_regionkey, r_name FROM region")
def _(v):
    return v("region").select("r_regionkey", "r_name")


@query("s2_conform", "SELECT p_partkey, p_name, 'general' AS category, 0::BIGINT AS sort_order, p_size FROM part")
def _(v):
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("category", T.StringType()), T.StructField("sort_order", T.LongType())])
    return src.conform(v("part").select("p_partkey", "p_name", "p_size"), schema, {"category": "general", "sort_order": 0})


@query("s8_train_eval_split")
def _(v):
    return src.with_split(v("documents").select("doc_id", "n_chars"), "doc_id")


_SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?\n])\s*', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_SENTS = f"sents AS (SELECT doc_id, n_chars, CASE WHEN len({_SENT}) > 0 THEN {_SENT} ELSE [text] END AS ss FROM documents)"
_CUES = f"""{_SENTS}, one AS (SELECT doc_id, unnest(ss) AS text, unnest(range(len(ss))) AS i, n_chars / 15.0 / len(ss) AS share FROM sents),
cue AS (SELECT doc_id, i::INT AS i, text, start, start + share - 0.2 AS "end" FROM (SELECT *, coalesce(sum(share) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM one))"""


def _cue_rows(v):
    df = v("documents").select("doc_id", text.sentences(c("text")).alias("ss"), (c("n_chars") / 15.0).alias("dur"))
    return df.select("doc_id", F.explode(text.cues(c("ss"), c("dur"))).alias("q")).select("doc_id", "q.*")


@query("s9_subtitles", f"WITH {_CUES} SELECT doc_id, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM cue GROUP BY doc_id")
def _(v):
    df = _cue_rows(v).withColumn("start_code", text.timecode(c("start"))).withColumn("end_code", text.timecode(F.greatest("end", lit(0.0))))
    lengths = df.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
    srt = src.render_srt(df)
    return srt.join(lengths, "doc_id").filter(F.length("srt") > c("chars")).select("doc_id", "n", "chars")


# filters


@query("p1_owner_scope", "SELECT v.id AS viewer_id, false AS sees_all, r.id AS id FROM users_v v JOIN results_v r ON r.voice_id = v.id WHERE v.level > 10 UNION ALL SELECT id, true, NULL FROM users_v WHERE level <= 10")
def _(v):
    return rel.scopes(v("results_v"), v("users_v"), "voice_id").select("viewer_id", "sees_all", "id")


@query("p2_visible_cards", "SELECT id FROM cards_v WHERE class_num = 1 OR coalesce(category IN ('ECONOMY BRASS', 'STANDARD STEEL'), false)")
def _(v):
    return rel.visible_cards(v("cards_v"), lit(1), "class_num", ("ECONOMY BRASS", "STANDARD STEEL")).select("id")


@query("p3_text_search", r"SELECT doc_id FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%the%license%'")
def _(v):
    return rel.text_search(v("documents"), "text", "THE%License").select("doc_id")


@query("p4_optional_filters", "SELECT id FROM cards_v WHERE \"week\" = 7")
def _(v):
    return rel.optional_filters(v("cards_v"), subject=None, week=7, category="").select("id")


@query("p5_pending_work", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') AND (nullif(lang, 'en') IS NULL) AND length(text) >= 1")
def _(v):
    return rel.pending_work(v("documents").withColumn("out", F.nullif("lang", lit("en"))), ["src1", "src2"], "source", "out", "text").select("doc_id")


@query("p6_lookup", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer)")
def _(v):
    return rel.lookup(v("orders"), v("customer").select(c("c_custkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query("p7_local_day", "SELECT event_id FROM events WHERE (ts + INTERVAL 9 HOURS)::DATE = DATE '2024-01-10'")
def _(v):
    return rel.on_local_day(v("events"), "ts", "2024-01-10").select("event_id")


@query("p8_valid_tokens", f"SELECT event_id FROM events WHERE event_type <> 'click' AND ts + INTERVAL 24 HOURS > TIMESTAMP '{NOW}'")
def _(v):
    e = v("events").withColumns({"used": (c("event_type") == "click").cast("int"), "expires_at": c("ts") + F.expr("INTERVAL 24 HOURS")})
    return rel.valid_tokens(e, F.to_timestamp_ntz(lit(NOW))).select("event_id")


_EMAIL = r"'^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$'"


@query("p9_valid_email", f"SELECT DISTINCT w FROM (SELECT lower(trim(unnest(string_split(text, ' ')))) AS w FROM documents) WHERE regexp_matches(w, {_EMAIL})")
def _(v):
    return v("documents").select(F.explode(F.split("text", " ")).alias("w")).select(rel.valid_email(c("w")).alias("w")).filter("w is not null").distinct()


@query("p10_filter_users", "SELECT c_custkey FROM customer WHERE contains(lower(c_name), '11') AND coalesce(c_mktsegment, 'free') = 'BUILDING'")
def _(v):
    u = v("customer").select("c_custkey", c("c_name").alias("display_name"), lit("").alias("email"), c("c_mktsegment").alias("plan"))
    return rel.filter_users(u, "11", "BUILDING").select("c_custkey")


@query("p11_rules", "SELECT id, rule FROM (SELECT id, unnest([CASE WHEN NOT level <= 200 THEN 'level' END, CASE WHEN NOT plan IN ('BUILDING', 'MACHINERY') THEN 'plan' END]) AS rule FROM users_v) WHERE rule IS NOT NULL")
def _(v):
    return rel.check_rules(v("users_v"), "id", {"level": c("level") <= 200, "plan": c("plan").isin("BUILDING", "MACHINERY")})


@query("p12_public_view", "SELECT id, display_name FROM users_v")
def _(v):
    return rel.public_view(v("users_v"), ["id", "display_name"])


@query("p13_patch", "SELECT p_partkey, CASE WHEN p_size > 20 THEN 'new' ELSE p_brand END AS p_brand FROM part")
def _(v):
    patches = v("part").filter("p_size > 20").select("p_partkey", F.array(lit("p_brand"), lit("p_name")).alias("present"), lit("new").alias("p_brand"), lit("x").alias("p_name"))
    return rel.apply_patch(v("part").select("p_partkey", "p_brand"), patches, "p_partkey", ["p_brand"], True)


@query("p14_script", "SELECT doc_id, regexp_matches(text, '[áéíóúñ]') AS accented FROM documents")
def _(v):
    return v("documents").select("doc_id", text.has_script(c("text"), "áéíóúñ").alias("accented"))


@query("p15_noise_lines", r"SELECT page, line_no::INT AS line_no FROM lines_v WHERE length(line) >= 3 AND NOT regexp_matches(line, '^\d+$') AND NOT contains(line, 'License')")
def _(v):
    return rel.drop_noise_lines(v("lines_v"), "line", 3, ["License"]).select("page", "line_no")


@query("p16_sources", r"SELECT page_id, regexp_matches(url, '^https?://([a-z0-9.-]+\.)?(example\.com|example\.org)(/|$)') OR regexp_matches(lower(url), '\.(mp3|wav)$') AS ok FROM pages")
def _(v):
    return v("pages").select("page_id", rel.allowed_source(c("url"), ["example.com", "example.org"], [".mp3", ".wav"]).alias("ok"))


@query("p17_notes", "SELECT id FROM cards_v WHERE subject = 'Brand#11' AND class_num = 2")
def _(v):
    return rel.optional_filters(v("cards_v"), subject="Brand#11", class_num=2, week=0).orderBy(F.desc("id")).select("id")


@query("p18_tiers", "SELECT id, CASE WHEN level = 0 THEN 'owner' WHEN level <= 9 THEN 'admin' WHEN level <= 49 THEN 'manager' WHEN level <= 99 THEN 'staff' WHEN level <= 199 THEN 'member' WHEN level <= 254 THEN 'guest' ELSE 'new' END AS tier FROM users_v")
def _(v):
    return v("users_v").select("id", rel.level_tier(c("level")).alias("tier"))


# joins


@query("j1_names", "SELECT r.id, r.created_at, u.display_name AS voice FROM results_v r LEFT JOIN users_v u ON r.voice_id = u.id")
def _(v):
    return rel.with_name(v("results_v"), v("users_v"), "voice_id", "id", "display_name", "voice").select("id", "created_at", "voice")


@query("j2_members", "SELECT folder_id, user_id, permission, display_name FROM members_v JOIN users_v ON user_id = id")
def _(v):
    return rel.folder_members(v("members_v"), v("users_v")).select("folder_id", "user_id", "permission", "display_name")


@query("j3_reviews", "SELECT r.id, k.chinese AS voice_name, u.display_name AS requester, f.name AS folder_name FROM reviews_v r JOIN cards_v k ON r.voice_id = k.id JOIN users_v u ON r.requested_by = u.id LEFT JOIN folders_v f ON r.shared_folder_id = f.id WHERE status = 'pending'")
def _(v):
    voices = v("cards_v").select("id", c("chinese").alias("name"))
    return rel.pending_reviews(v("reviews_v"), voices, v("users_v"), v("folders_v")).select("id", "voice_name", "requester", "folder_name")


_COUNTS = "(SELECT count(*) FROM voices_v x WHERE x.shared_folder_id = f.id AND x.folder_type = 'shared') AS voice_count"


@query("j4_folders", f"SELECT f.id, f.name, u.display_name AS owner_name, m.permission, {_COUNTS} FROM folders_v f JOIN members_v m ON m.folder_id = f.id AND m.user_id = 7 LEFT JOIN users_v u ON u.id = f.owner_id")
def _(v):
    return rel.accessible_folders(v("folders_v"), v("members_v"), v("users_v"), v("voices_v"), 7, False).select("id", "name", "owner_name", "permission", "voice_count")


@query("j5_recent_attempts", "SELECT r.user_id, r.id, k.chinese FROM (SELECT * FROM records_v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 20) r LEFT JOIN cards_v k ON r.card_id = k.id")
def _(v):
    return rel.recent_attempts(v("records_v"), v("cards_v"), 20).select("user_id", "id", "chinese")


@query("j6_mentions", "SELECT DISTINCT doc_id AS page_id, item_id AS card_id FROM documents d JOIN benchmark b ON translate(b.text, ',.', '') <> '' AND contains(translate(d.text, ',.', ''), translate(b.text, ',.', ''))")
def _(v):
    return rel.mentions(v("documents").select(c("doc_id").alias("page_id"), "text"), v("benchmark").select(c("item_id").alias("card_id"), "text"))


@query("j7_any_width", """WITH p AS (SELECT DISTINCT pdf, page FROM lines_v), l AS (SELECT pdf, max(page) AS last_page FROM p GROUP BY pdf),
s AS (SELECT pdf, last_page, k, k * 7 AS start, k * 7 + (1 << (k % 18)::INT) - 1 AS stop FROM (SELECT pdf, last_page, unnest(range(0, last_page // 7 + 1)) AS k FROM l) WHERE k % 5 = 0)
SELECT p.pdf, p.page, count(*) AS sections, sum(p.page - start)::BIGINT AS indexes, max(s.k) AS latest FROM p JOIN s ON p.pdf = s.pdf AND p.page BETWEEN start AND least(stop, last_page) GROUP BY ALL""")
def _(v):
    """Sections from 1 to 131,072 pages wide."""
    pages = v("lines_v").select("pdf", "page").distinct()
    last = pages.groupBy("pdf").agg(F.max("page").alias("last_page"))
    s = last.select("pdf", F.explode(F.sequence(lit(0).cast("long"), F.floor(c("last_page") / 7).cast("long"))).alias("section")).filter("section % 5 = 0")
    s = s.withColumns({"start_page": c("section") * 7, "end_page": F.expr("section * 7 + shiftleft(1L, cast(section % 18 AS int)) - 1")})
    got = rel.pages_in_sections(pages, s, last).groupBy("pdf", "page")
    return got.agg(F.count("*").alias("sections"), F.sum("page_index").alias("indexes"), F.max("section").alias("latest"))


_SECTIONS = """WITH p AS (SELECT DISTINCT pdf, page FROM lines_v), l AS (SELECT pdf, max(page) AS last_page FROM p GROUP BY pdf),
s AS (SELECT pdf, last_page, unnest(range(0, last_page // 100 + 1)) AS k FROM l)
SELECT p.pdf, p.page, s.k AS section, p.page - s.k * 100 AS page_index FROM p JOIN s ON p.pdf = s.pdf AND p.page BETWEEN s.k * 100 AND least(s.k * 100 + 150, last_page)"""


@query("j7_sections", _SECTIONS)
@query("j7_sections_whole", _SECTIONS)
def _(v):
    """Sections of 150 pages, 100 apart, up to each file's last page."""
    pages = v("lines_v").select("pdf", "page").distinct()
    last = pages.groupBy("pdf").agg(F.max("page").alias("last_page"))
    sections = last.select("pdf", F.explode(F.sequence(lit(0).cast("long"), F.floor(c("last_page") / 100).cast("long"))).alias("section"))
    sections = sections.withColumns({"start_page": c("section") * 100, "end_page": c("section") * 100 + 150})
    return rel.pages_in_sections(pages, sections, last).select("pdf", "page", "section", "page_index")


@query("j8_gloss", "SELECT p.p_partkey, b.gloss FROM part p LEFT JOIN (SELECT p_name, min(p_brand) AS gloss FROM part WHERE p_size < 25 GROUP BY 1) b USING (p_name)")
def _(v):
    d = v("part").filter("p_size < 25").groupBy("p_name").agg(F.min("p_brand").alias("gloss"))
    return v("part").join(d, "p_name", "left").select("p_partkey", "gloss")


@query("j10_cascade", "SELECT 'parent' AS t, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 UNION ALL SELECT 'child', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)")
def _(v):
    keys = v("orders").filter("o_custkey % 7 = 0")
    p, k = rel.cascade_delete(v("orders"), [(v("lineitem"), "l_orderkey")], keys, "o_orderkey")
    count = lambda df, t: df.agg(F.count("*").alias("n")).select(lit(t).alias("t"), "n")
    return count(p, "parent").unionByName(count(k, "child"))


@query("j11_permissions", "SELECT u.id AS user_id, f.id AS folder_id, CASE WHEN u.level <= 10 THEN 'admin' ELSE m.permission END AS permission FROM users_v u CROSS JOIN folders_v f LEFT JOIN members_v m ON m.user_id = u.id AND m.folder_id = f.id WHERE u.level <= 10 OR m.permission IS NOT NULL")
def _(v):
    return rel.effective_permission(v("users_v"), v("folders_v"), v("members_v")).select("user_id", "folder_id", "permission")


@query("j11_rules", "SELECT id AS user_id, NULL::INT AS folder_id, 'admin' AS permission, true AS sees_all, true AS can_edit, true AS can_admin FROM users_v WHERE level <= 10 UNION ALL SELECT user_id, folder_id, permission, false, permission IN ('edit', 'admin'), permission = 'admin' FROM members_v WHERE user_id NOT IN (SELECT id FROM users_v WHERE level <= 10)")
def _(v):
    return rel.permission_rules(v("users_v"), v("members_v"))


# aggregates


@query("a1_study_stats", f"SELECT user_id, count(*) AS attempts, round(coalesce(avg(CASE WHEN score > 0 THEN score END), 0), 1) AS avg_score, count(*) FILTER (is_starred) AS starred, count(*) FILTER ((created_at + INTERVAL 9 HOURS)::DATE = (TIMESTAMP '{NOW}' + INTERVAL 9 HOURS)::DATE) AS today FROM records_v GROUP BY 1")
def _(v):
    return rel.study_stats(v("records_v"), NOW)


@query("a2_subject_counts", "SELECT subject, \"week\", class_num, count(*) AS n FROM cards_v WHERE subject <> '' GROUP BY ALL")
def _(v):
    return rel.subject_counts(v("cards_v"))


_PROGRESS = "SELECT k.id, max(r.score) AS best, count(r.id) AS attempts, count(*) FILTER (r.score >= 100) AS perfect FROM cards_v k LEFT JOIN records_v r ON r.card_id = k.id GROUP BY k.id"


@query("a3_card_progress", _PROGRESS)
def _(v):
    return rel.card_progress(v("cards_v"), v("records_v")).select("id", "best", "attempts", "perfect")


@query("a4_daily_stats", "SELECT user_id, (created_at + INTERVAL 9 HOURS)::DATE AS day, count(*) AS n, round(avg(score), 1) AS avg_score, max(score) AS max_score FROM records_v GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 7")
def _(v):
    return rel.daily_stats(v("records_v"), 7)


@query("a5_feedback", "SELECT k.id, coalesce(avg(f.score), 0.0) AS avg_score, count(f.score) AS n FROM cards_v k LEFT JOIN feedback_v f ON f.checkpoint_id = k.id AND f.checkpoint_id <> 0 GROUP BY 1")
def _(v):
    return rel.feedback_rollup(v("cards_v").select("id"), v("feedback_v"))


@query("a6_folder_counts", f"SELECT f.id, {_COUNTS} FROM folders_v f")
def _(v):
    return rel.folder_counts(v("folders_v"), v("voices_v")).select("id", "voice_count")


@query("a7_distinct", "SELECT DISTINCT category FROM cards_v")
def _(v):
    return rel.distinct_values(v("cards_v"), "category")


@query("a8_user_stats", "SELECT count(*) AS total, count(*) FILTER (level <= 10) AS admins, count(*) FILTER (plan = 'MACHINERY') AS beta, count(*) FILTER (plan IN ('BUILDING', 'AUTOMOBILE')) AS paid, count(*) FILTER (plan = 'FURNITURE') AS voice FROM users_v")
def _(v):
    u = v("users_v").withColumn("user_type", F.when(c("plan") == "MACHINERY", "beta").when(c("plan") == "FURNITURE", "voice"))
    return rel.user_stats(u, ("BUILDING", "AUTOMOBILE"))


@query("a9_eligibility", "WITH g AS (SELECT l_orderkey AS group_id, sum(l_quantity) AS seconds, arg_min(p_name, l_linenumber * 1000000 + l_partkey) AS name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) SELECT *, CASE WHEN seconds < 30 THEN 'reject' WHEN seconds < 120 THEN 'warn' ELSE 'ok' END AS verdict FROM g")
def _(v):
    chosen = v("lineitem").select(c("l_orderkey").alias("group_id"), (c("l_linenumber") * 1000000 + c("l_partkey")).alias("pos"), c("l_partkey").alias("voice_id"), c("l_quantity").alias("duration"))
    return rel.training_eligibility(chosen, v("part").select(c("p_partkey").alias("voice_id"), c("p_name").alias("name")))


@query("a10_import_summary", "SELECT subject || ' ' || \"week\" || ' ' || class_num AS key, count(*) AS n FROM cards_v GROUP BY 1")
def _(v):
    return rel.import_summary(v("cards_v"))


@query("a11_page_info", "SELECT count(*) AS total, greatest(1, ceil(count(*) / 20.0))::BIGINT AS total_pages FROM orders")
def _(v):
    return rel.page_info(v("orders"), 20)


@query("a12_best_attempt", "SELECT user_id, card_id, score, id AS index, tries FROM (SELECT *, count(*) OVER (PARTITION BY user_id, card_id) AS tries FROM records_v QUALIFY row_number() OVER (PARTITION BY user_id, card_id ORDER BY score DESC, id) = 1)")
def _(v):
    return rel.best_attempt(v("records_v").withColumn("index", c("id")), ["user_id", "card_id"])


@query("a13_progress", "SELECT source, lang, count(*) AS total, count(*) FILTER (n_chars > 1000) AS done FROM documents GROUP BY 1, 2")
def _(v):
    return rel.work_progress(v("documents"), ["source", "lang"], c("n_chars") > 1000)


@query("a14_dashboard")
def _(v):
    return rel.dashboard(v("records_v"), v("cards_v"), NOW)


_DASH = f"""WITH k AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'textbook' ELSE category END AS kind, id % 170 AS owner FROM cards_v), r AS (SELECT *, (created_at + INTERVAL 9 HOURS)::DATE AS day FROM records_v),
t AS (SELECT user_id, count(*) AS attempts, round(coalesce(avg(score) FILTER (score > 0), 0), 1) AS avg_score, count(*) FILTER (is_starred) AS starred, count(*) FILTER (day = (TIMESTAMP '{NOW}' + INTERVAL 9 HOURS)::DATE) AS today FROM r GROUP BY 1),
d AS (SELECT user_id, string_agg(concat_ws('/', day, n, a, m), ' ' ORDER BY day DESC) AS daily FROM (SELECT user_id, day, count(*) AS n, round(avg(score), 1) AS a, max(score) AS m FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY day DESC) <= 7) GROUP BY 1),
l AS (SELECT r.user_id, string_agg(concat_ws('/', epoch_us(created_at), r.id, card_id, chinese, score), ' ' ORDER BY created_at DESC, r.id DESC) AS recent FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 20) r LEFT JOIN k ON k.id = card_id GROUP BY 1),
o AS (SELECT owner AS user_id, count(*) AS own FROM k WHERE kind NOT IN ('textbook', 'pronunciation') GROUP BY 1)
SELECT coalesce(t.user_id, o.user_id)::BIGINT AS user_id, coalesce(attempts, 0) AS attempts, coalesce(avg_score, 0) AS avg_score, coalesce(starred, 0) AS starred, coalesce(today, 0) AS today,
  coalesce(own, 0) + (SELECT count(*) FROM k WHERE kind IN ('textbook', 'pronunciation')) AS total_cards, coalesce(daily, '') AS daily, coalesce(recent, '') AS recent
FROM t FULL JOIN o ON o.user_id = t.user_id LEFT JOIN d ON d.user_id = t.user_id LEFT JOIN l ON l.user_id = t.user_id"""


@query("a14_dashboard_text", _DASH)
def _(v):
    """The dashboard with owned and shared cards; its arrays as text, so that all of it is compared."""
    cards = v("cards_v").withColumns({"category": F.when(c("id") % 4 == 0, "textbook").otherwise(c("category")), "user_id": (c("id") % 170).cast("long")})
    df = rel.dashboard(v("records_v"), cards, NOW)
    joined = lambda name, *parts: F.coalesce(F.array_join(F.transform(name, lambda x: F.concat_ws("/", *(p(x) for p in parts))), " "), lit("")).alias(name)
    field = lambda k: lambda x: x[k].cast("string")
    micros = lambda x: F.unix_micros(x["created_at"].cast("timestamp")).cast("string")
    daily, recent = joined("daily", *map(field, ("day", "n", "avg_score", "max_score"))), joined("recent", micros, *map(field, ("id", "card_id", "chinese", "score")))
    return df.select("user_id", "attempts", "avg_score", "starred", "today", "total_cards", daily, recent)


# ordering


@query("w1_page", "SELECT id, created_at FROM results_v ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40")
def _(v):
    return seq.page(v("results_v"), "created_at", "id", 3, 20).select("id", "created_at")


@query("w1_deep_page", "SELECT o_orderkey, o_orderdate, 'index' AS way FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET (SELECT count(*) // 2 // 20 * 20 FROM orders)) UNION ALL SELECT o_orderkey, o_orderdate, 'cursor' FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET (SELECT count(*) // 2 // 20 * 20 + 20 FROM orders))")
def _(v):
    o = v("orders").select("o_orderkey", "o_orderdate")
    index = seq.PageIndex(o, "o_orderdate", "o_orderkey", 100)
    page = index.page(index.rows // 2 // 20 + 1, 20)
    last = page.orderBy("o_orderdate", "o_orderkey").first()
    after = seq.page_after(o, "o_orderdate", "o_orderkey", 20, (last["o_orderdate"], last["o_orderkey"]))
    return page.withColumn("way", lit("index")).unionByName(after.withColumn("way", lit("cursor")))


@query("w1_ranked_progress", f"SELECT * FROM ({_PROGRESS}) ORDER BY attempts DESC, id LIMIT 50")
def _(v):
    return rel.card_progress(v("cards_v"), v("records_v")).select("id", "best", "attempts", "perfect").orderBy(F.desc("attempts"), "id").limit(50)


_CP = "cp AS (SELECT event_id AS id, user_id AS voice_id, value AS avg_score, ts AS created_at, (event_type = 'click')::INT AS is_active FROM events)"


def _cp(v):
    return v("events").select(c("event_id").alias("id"), c("user_id").alias("voice_id"), c("value").alias("avg_score"), c("ts").alias("created_at"), (c("event_type") == "click").cast("int").alias("is_active"))


@query("w2_rank", f"WITH {_CP} SELECT id, voice_id, row_number() OVER (PARTITION BY voice_id ORDER BY avg_score DESC, created_at DESC, id)::INT AS rank FROM cp")
def _(v):
    return seq.rank_checkpoints(_cp(v)).select("id", "voice_id", "rank")


@query("w3_latest", "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC)::INT AS rn FROM records_v QUALIFY rn <= 20")
def _(v):
    return rel.latest_per(v("records_v"), "user_id", "created_at", 20, "id").select("user_id", "id", "rn")


@query("w4_activate", f"WITH {_CP}, ch AS (SELECT voice_id, max(id) AS m FROM cp WHERE voice_id % 2 = 0 GROUP BY 1) SELECT id, CASE WHEN id IN (SELECT m FROM ch) THEN 1 WHEN voice_id % 2 = 0 THEN 0 ELSE is_active END AS is_active FROM cp")
def _(v):
    choices = _cp(v).filter("voice_id % 2 = 0").groupBy("voice_id").agg(F.max("id").alias("checkpoint_id"))
    return seq.activate(_cp(v), choices).select("id", "is_active")


@query("w5_dedupe", "SELECT line, page, line_no::INT AS line_no FROM lines_v QUALIFY row_number() OVER (PARTITION BY line ORDER BY page, line_no) = 1")
def _(v):
    return seq.dedupe_first(v("lines_v").select("line", "page", "line_no"), ["line"], ["page", "line_no"])


_ISLANDS = """isl AS (SELECT *, sum(new) OVER (PARTITION BY speaker ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY speaker ORDER BY start, "end") < 1.0 THEN 0 ELSE 1 END AS new FROM segments_v)),
merged AS (SELECT speaker, island, min(start) AS start, arg_max("end", struct_pack(s := start, e := "end")) AS "end", count(*) AS n, list_reduce(list(energy ORDER BY start, "end", energy), lambda a, x: (a + x) / 2) AS energy FROM isl GROUP BY 1, 2)"""


@query("w6_islands", f"WITH {_ISLANDS} SELECT speaker, island::BIGINT AS island, round(start, 6) AS start, round(\"end\", 6) AS \"end\", n::INT AS n, round(energy + 1e-8, 6) AS energy FROM merged")
def _(v):
    df = seq.merge_segments(v("segments_v"))
    return df.select("speaker", c("island").cast("long").alias("island"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n", F.round(c("energy") + 1e-8, 6).alias("energy"))


def _fill_sql(order: str, least: float, budget: float, ok: str, first: bool) -> str:
    over = f"OVER (PARTITION BY speaker ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    extra = f" OR row_number() OVER (PARTITION BY speaker ORDER BY {order}) = 1" if first else ""
    return f"""WITH a AS (SELECT *, "end" - start AS dur FROM segments_v), b AS (SELECT *, sum(dur) {over} AS s, {budget} - (sum(dur) {over} - dur) AS rest{', ' + extra[4:] + ' AS fst' if first else ', false AS fst'} FROM a WHERE dur >= {least})
SELECT event_id, round(CASE WHEN s <= {budget} THEN dur ELSE rest END, 6) AS taken FROM b WHERE s <= {budget} OR (rest > 0 AND ({ok} OR fst))"""


@query("w7_budget", _fill_sql('dur DESC, start, "end"', 1.0, 20.0, "rest >= 0.5", False))
def _(v):
    return seq.select_budget(v("segments_v"), min_len=1.0, budget=20.0, min_tail=0.5).select("event_id", F.round("taken", 6).alias("taken"))


@query("w8_preview", _fill_sql('start, "end"', 0.0, 10.0, "rest > 1.0", True))
def _(v):
    return seq.select_preview(v("segments_v").filter("end - start >= 0.0")).select("event_id", F.round("taken", 6).alias("taken"))


@query("w9_artifact", "SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN max(k) FILTER (o_orderstatus = 'P') ELSE max(k) END AS k FROM (SELECT *, o_orderpriority || o_orderkey AS k FROM orders) GROUP BY 1")
def _(v):
    return seq.pick_artifact(v("orders").withColumn("k", F.concat("o_orderpriority", c("o_orderkey").cast("string"))), "o_custkey", c("o_orderstatus") == "P", "k")


_PARTS = "p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)"


def _parts(v):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return v("lineitem").select("l_orderkey", c("l_quantity").alias("dur"), F.row_number().over(w).alias("i"))


@query("w10_timeline", f"WITH {_PARTS} SELECT l_orderkey, i::INT AS i, round(coalesce(sum(l_quantity + 0.2) OVER (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS \"offset\" FROM p")
def _(v):
    return seq.assemble_timeline(_parts(v), "l_orderkey", "i", 0.2).select("l_orderkey", "i", F.round("offset", 6).alias("offset"))


_SEGS = 'sg AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY start, event_id) AS i FROM segments_v)'


@query("w11_split", f"WITH {_SEGS} SELECT speaker, count(*)::BIGINT AS n, round(sum(\"end\" - start), 4) AS total FROM (SELECT speaker, start, \"end\" FROM sg WHERE NOT (i % 2 = 0 AND \"end\" > start) UNION ALL SELECT speaker, start, (start + \"end\") / 2 FROM sg WHERE i % 2 = 0 AND \"end\" > start UNION ALL SELECT speaker, (start + \"end\") / 2, \"end\" FROM sg WHERE i % 2 = 0 AND \"end\" > start) GROUP BY 1")
def _(v):
    i = F.row_number().over(Window.partitionBy("speaker").orderBy("start", "event_id"))
    s = v("segments_v").withColumn("i", i).select("speaker", "i", "start", "end")
    cuts = s.filter("i % 2 = 0").select("speaker", "i", ((c("start") + c("end")) / 2).alias("cut"))
    return seq.split_item(s, cuts, "speaker", "i").groupBy("speaker").agg(F.count("*").alias("n"), F.round(F.sum(c("end") - c("start")), 4).alias("total"))


@query("w12_clip", 'SELECT event_id, round(least(start + 2, "end") - greatest(start, start + 0.5), 6) AS dur FROM segments_v WHERE least(start + 2, "end") > start + 0.5')
def _(v):
    return seq.clip_item(v("segments_v"), c("start") + 0.5, c("start") + 2).select("event_id", F.round(c("end") - c("start"), 6).alias("dur"))


@query("w13_bounds", "SELECT event_id, least(value, 30.0) AS dur FROM events WHERE value >= 6")
def _(v):
    return seq.bound_length(v("events").withColumn("dur", c("value"))).select("event_id", "dur")


@query("w14_voices", "SELECT s_suppkey AS id, (s_acctbal > 5000)::INT AS is_favorite FROM supplier")
def _(v):
    s = v("supplier").select(c("s_suppkey").alias("id"), (c("s_acctbal") > 5000).cast("int").alias("is_favorite"), c("s_acctbal").alias("created_at"))
    return seq.voice_choices(s, True).select("id", "is_favorite")


_HOST = "h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, contains(url, '#') AS derived FROM pages)"


@query("w15_siblings", f"WITH {_HOST}, b AS (SELECT page_id, host FROM h WHERE NOT derived), n AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY host ORDER BY page_id) <= 5) SELECT b.page_id, n.page_id AS sibling FROM b JOIN n USING (host) WHERE b.page_id <> n.page_id QUALIFY row_number() OVER (PARTITION BY b.page_id ORDER BY n.page_id) < 5")
def _(v):
    p = v("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), c("url").contains("#").alias("derived"))
    return seq.siblings(p, "page_id", "host", c("derived")).select("page_id", "sibling")


# text


def _read4(d: str) -> str:
    digits = "['', '일', '이', '삼', '사', '오', '육', '칠', '팔', '구']"
    out = []
    for k, unit in ((1000, "천"), (100, "백"), (10, "십"), (1, "")):
        x = f"(({d}) // {k}) % 10"
        name = f"{digits}[({x}) + 1]" if k == 1 else f"CASE WHEN {x} = 1 THEN '' ELSE {digits}[({x}) + 1] END"
        out.append(f"CASE WHEN {x} = 0 THEN '' ELSE ({name}) || '{unit}' END")
    return " || ".join(f"({x})" for x in out)


@query("t1_ko_number", f"SELECT DISTINCT l_partkey AS n, CASE WHEN l_partkey >= 10000 THEN ({_read4('l_partkey // 10000')}) || '만' ELSE '' END || {_read4('l_partkey % 10000')} AS reading FROM lineitem WHERE l_partkey > 0")
def _(v):
    return v("lineitem").filter("l_partkey > 0").select(c("l_partkey").alias("n")).distinct().withColumn("reading", text.ko_number(c("n")))


@query("t2_ko_native", f"SELECT DISTINCT q AS n, CASE WHEN q <= 24 THEN [{', '.join(repr(w) for w in text.KO_NATIVE)}][q] ELSE {_read4('q')} END AS reading FROM (SELECT l_quantity::INT AS q FROM lineitem) WHERE q > 0")
def _(v):
    return v("lineitem").select(c("l_quantity").cast("int").alias("n")).filter("n > 0").distinct().withColumn("reading", text.ko_native(c("n")))


_KO_READ = "[" + ", ".join(repr(x) for x in text.KO_READ) + "]"


@query("t3_ko_decimal", f"SELECT x, CASE WHEN split_part(x, '.', 1) = '0' THEN '영' ELSE {_read4("split_part(x, '.', 1)::INT")} END || ' 점 ' || array_to_string(list_transform(string_split(split_part(x, '.', 2), ''), lambda d: {_KO_READ}[d::INT + 1]), '') AS reading FROM (SELECT DISTINCT l_discount::VARCHAR AS x FROM lineitem)")
def _(v):
    return v("lineitem").select(c("l_discount").cast("string").alias("x")).distinct().withColumn("reading", text.ko_decimal(c("x")))


@query("t4_normalize_ko")
def _(v):
    return v("documents").select("doc_id", text.normalize_ko(c("text")).alias("spoken"))


def _zh(n: str) -> str:
    z = lambda x: "[" + ", ".join(repr(d) for d in text.ZH_DIGITS) + f"][({x}) + 1]"
    two = lambda v: f"CASE WHEN {v} < 10 THEN {z(v)} ELSE CASE WHEN {v} // 10 = 1 THEN '' ELSE {z(f'{v} // 10')} END || '十' || CASE WHEN {v} % 10 = 0 THEN '' ELSE {z(f'{v} % 10')} END END"
    more = lambda v, u, name, low: f"CASE WHEN {v} < {u} THEN {low(v)} ELSE {z(f'{v} // {u}')} || '{name}' || CASE WHEN {v} % {u} = 0 THEN '' ELSE CASE WHEN {v} % {u} < {u // 10} THEN '零' ELSE '' END || {low(f'({v} % {u})')} END END"
    three = lambda v: more(v, 100, "百", two)
    four = lambda v: more(v, 1000, "千", three)
    return f"CASE WHEN {n} < 10000 THEN {four(n)} ELSE {four(f'({n} // 10000)')} || '万' || CASE WHEN {n} % 10000 = 0 THEN '' ELSE CASE WHEN {n} % 10000 < 1000 THEN '零' ELSE '' END || {four(f'({n} % 10000)')} END END"


def _ja(n: str) -> str:
    j = lambda x: "[" + ", ".join(repr(d) for d in text.JA_DIGITS) + f"][({x}) + 1]"
    odd = {(100, 3): "さんびゃく", (100, 6): "ろっぴゃく", (100, 8): "はっぴゃく", (1000, 3): "さんぜん", (1000, 8): "はっせん"}

    def part(v: str, u: int, name: str) -> str:
        q = f"(({v}) // {u} % 10)"
        cases = " ".join(f"WHEN {q} = {k} THEN '{w}'" for (x, k), w in odd.items() if x == u)
        return f"CASE WHEN {q} = 0 THEN '' WHEN {q} = 1 THEN '{name}' {cases} ELSE {j(q)} || '{name}' END"

    four = lambda v: f"({part(v, 1000, 'せん')} || {part(v, 100, 'ひゃく')} || {part(v, 10, 'じゅう')} || CASE WHEN ({v}) % 10 = 0 THEN '' ELSE {j(f'({v}) % 10')} END)"
    return f"CASE WHEN {n} >= 10000 THEN {four(f'{n} // 10000')} || 'まん' ELSE '' END || {four(f'{n} % 10000')}"


@query("t5_zh_number", f"SELECT n, {_zh('n')} AS reading FROM (SELECT DISTINCT l_partkey AS n FROM lineitem)")
def _(v):
    return v("lineitem").select(c("l_partkey").alias("n")).distinct().withColumn("reading", text.zh_number(c("n")))


@query("t6_ja_number", f"SELECT n, CASE WHEN n = 0 THEN 'ゼロ' ELSE {_ja('n')} END AS reading FROM (SELECT DISTINCT l_partkey AS n FROM lineitem)")
def _(v):
    return v("lineitem").select(c("l_partkey").alias("n")).distinct().withColumn("reading", text.ja_number(c("n")))


@query("t7_normalize_zh_ja")
def _(v):
    return v("documents").select("doc_id", text.normalize_zh_ja(c("text"), "zh-cn").alias("zh"), text.normalize_zh_ja(c("text"), "ja").alias("ja"))


@query("t8_acronyms")
def _(v):
    return v("documents").select("doc_id", text.expand_acronyms(c("text")).alias("spoken"))


def _signs() -> str:
    out = "text"
    for a, b in text.KO_SIGNS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


@query("t9_symbols", f"SELECT doc_id, md5({_signs()}) AS spoken FROM documents")
def _(v):
    return v("documents").select("doc_id", F.md5(text.speak_symbols(c("text"), text.KO_SIGNS)).alias("spoken"))


@query("t10_segment_tokens")
def _(v):
    return v("conversations").select("conv_id", "turn", text.segment_tokens(c("text"), {"thean": "A"}, {"the": "B", "of": "C"}).alias("segmented"))


@query("t11_segment_chars")
def _(v):
    return v("part").select("p_partkey", text.segment_chars(c("p_name"), {"red": "1", "blue": "2", "part": "3", " ": "_"}).alias("segmented"))


@query("t12_sentences", f"WITH {_SENTS} SELECT doc_id, unnest(range(len(ss)))::INT AS i, unnest(ss) AS sentence FROM sents")
def _(v):
    return v("documents").select("doc_id", F.posexplode(text.sentences(c("text"))).alias("i", "sentence"))


@query("t13_chunks")
def _(v):
    return v("documents").select("doc_id", F.posexplode(text.pack_chunks(c("text"))).alias("i", "chunk"))


@query("t14_clauses", "WITH x AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([,;])', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '') AS g FROM documents) SELECT doc_id, CASE WHEN length(text) > 15 AND len(g) > 1 THEN len(g) ELSE 1 END::INT AS n, md5(array_to_string(CASE WHEN length(text) > 15 AND len(g) > 1 THEN g ELSE [text] END, '|')) AS h FROM x")
def _(v):
    g = v("documents").select("doc_id", text.clauses(c("text"), ",;").alias("g"))
    return g.select("doc_id", F.size("g").alias("n"), F.md5(F.array_join("g", "|")).alias("h"))


@query("t15_lines", "SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s, ' ')), lambda s: s <> '').len()::INT AS n FROM documents")
def _(v):
    return v("documents").select("doc_id", F.size(text.lines(c("text"))).alias("n"))


@query("t16_timecode", "SELECT DISTINCT l_quantity AS q, printf('%02d:%02d:%02d,%03d', (floor(q * 77.5)::BIGINT // 3600), (floor(q * 77.5)::BIGINT % 3600) // 60, floor(q * 77.5)::BIGINT % 60, floor((q * 77.5 - floor(q * 77.5)) * 1000)::BIGINT) AS code FROM lineitem")
def _(v):
    return v("lineitem").select(c("l_quantity").alias("q")).distinct().withColumn("code", text.timecode(c("q") * 77.5))


@query("t17_cues", f"WITH {_CUES} SELECT doc_id, i, text, round(start, 6) AS start, round(\"end\", 6) AS \"end\" FROM cue")
def _(v):
    return _cue_rows(v).select("doc_id", "i", "text", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("t18_terms", "WITH m AS (SELECT page, line_no, line, array_to_string(regexp_extract_all(line, '[áéíóúñüöäßçêèà]+'), '') AS term FROM lines_v) SELECT page, line_no::INT AS line_no, term FROM m WHERE length(term) >= 2")
def _(v):
    cls = "áéíóúñüöäßçêèà"
    return v("lines_v").select("page", "line_no", text.extract_terms(c("line"), cls, "a-zA-Z").alias("t")).filter("t is not null").select("page", "line_no", "t.term")


@query("t18_textbook", r"""WITH m AS (SELECT page, line_no, line, page % 2 = 0 AS spoken, regexp_extract_all(line, '[áéó]') AS han, array_to_string(regexp_extract_all(line, '[áéó]+'), '') AS term,
  array_to_string(list_filter(regexp_extract_all(line, '[a-zA-ZüÜíúñöäß]+'), lambda w: regexp_matches(w, '[íúñöäß]')), ' ') AS syl,
  trim(array_to_string(regexp_extract_all(regexp_replace(line, '[áéó]+', ' ', 'g'), '[A-Z]+[A-Z\s]*'), ' ')) AS rest,
  trim(array_to_string(regexp_extract_all(line, '[A-Z]+[A-Z\s]*'), ' ')) AS said, regexp_extract_all(line, '[\[【]([^\]】]+)[\]】]', 1) AS hints FROM lines_v)
SELECT page, line_no::INT AS line_no, CASE WHEN len(han) >= 2 THEN term WHEN len(han) > 0 THEN array_to_string(han, '') ELSE syl END AS term,
  CASE WHEN len(han) < 2 THEN concat_ws(' ', CASE WHEN len(hints) > 0 THEN '[' || array_to_string(hints, '] [') || ']' END, CASE WHEN said <> '' OR len(hints) = 0 THEN said END)
    WHEN syl <> '' THEN syl || CASE WHEN rest <> '' THEN ' — ' || rest ELSE '' END ELSE rest END AS gloss, CASE WHEN len(han) < 2 THEN syl END AS syllables
FROM m WHERE len(han) >= 2 OR spoken AND length(syl) >= 2""")
def _(v):
    t = text.textbook_terms(c("line"), c("page") % 2 == 0, "áéó", "áéó", "íúñöäß", "A-Z")
    return v("lines_v").select("page", "line_no", t.alias("t")).filter("t is not null").select("page", "line_no", "t.*")


@query("t19_notes", "WITH w AS (SELECT doc_id, lang || source AS a, source || lang AS b FROM documents), n AS (SELECT doc_id, list_filter(list_transform(range(1, least(length(a), length(b)) + 1), lambda i: CASE WHEN a[i] <> b[i] THEN a[i] || ': ' || a[i] || '→' || b[i] END), lambda s: s IS NOT NULL) AS l FROM w) SELECT doc_id, array_to_string(l[1:3], ' | ') AS note FROM n")
def _(v):
    w = v("documents").select("doc_id", F.concat("lang", "source").alias("a"), F.concat("source", "lang").alias("b"))
    return w.select("doc_id", text.reading_notes(c("a"), text.characters(c("a")), text.characters(c("b"))).alias("note"))


@query("t20_punct", "SELECT doc_id, md5(regexp_replace(text, '[\\s.,!?;:，。！？、；：\"''“”‘’()（）·~\\-]', '', 'g')) AS h FROM documents")
def _(v):
    return v("documents").select("doc_id", F.md5(text.strip_punct(c("text"))).alias("h"))


@query("t21_map_chars", f"SELECT doc_id, md5(translate(text, '{ACCENTS}', '{PLAIN}')) AS h FROM documents")
def _(v):
    return v("documents").select("doc_id", F.md5(text.map_chars(c("text"), TONES_OFF)).alias("h"))


@query("t22_names", r"WITH s AS (SELECT page_id, string_split(regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', ''), '_') AS p FROM pages) SELECT page_id, coalesce(list_filter(p, lambda x: NOT regexp_full_match(x, '[0-9a-fA-F]{6,}'))[1], p[1]) AS name FROM s")
def _(v):
    return v("pages").select("page_id", text.name_from_path(c("url")).alias("name"))


@query("t23_params", "SELECT event_id, least(greatest(coalesce(json_extract_string(props, '$.k')::DOUBLE, 5), 10), 60) AS k, 50 AS top_k FROM events")
def _(v):
    return v("events").select("event_id", text.clean_params(c("props"), {"k": (5.0, 10.0, 60.0), "top_k": (50.0, 1.0, 100.0)}).alias("p")).select("event_id", "p.k", "p.top_k")


@query("t24_presets", "SELECT p_partkey, CASE WHEN p_type LIKE '%STEEL' THEN 0.85 WHEN p_type LIKE '%BRASS' THEN 1.2 ELSE 1.0 END::DOUBLE AS speed FROM part")
def _(v):
    names = F.concat_ws(",", lit("unknown"), F.lower(F.substring_index("p_type", " ", -1)))
    return v("part").select("p_partkey", text.overlay_presets(names, {"steel": {"speed": 0.85}, "brass": {"speed": 1.2}}, {"speed": 1.0}).alias("p")).select("p_partkey", "p.speed")


@query("t25_gloss", "SELECT p_partkey, CASE WHEN p_size > 30 THEN p_brand WHEN p_size > 10 THEN p_type ELSE p_name END AS gloss, CASE WHEN p_size > 30 THEN 'stored' WHEN p_size > 10 THEN 'dictionary' ELSE 'external' END AS origin, p_size <= 30 AS write_back FROM part")
def _(v):
    g = text.resolve_gloss(F.when(c("p_size") > 30, c("p_brand")).otherwise(""), F.when(c("p_size") > 10, c("p_type")), c("p_name"))
    return v("part").select("p_partkey", g.alias("g")).select("p_partkey", "g.*")


@query("t26_section_summary", r"SELECT pdf, count(DISTINCT page) AS pages, count(*) AS kept FROM lines_v WHERE length(line) >= 2 AND NOT regexp_matches(line, '^\d+$') GROUP BY 1")
def _(v):
    return rel.drop_noise_lines(v("lines_v"), "line", 2, []).groupBy("pdf").agg(F.countDistinct("page").alias("pages"), F.count("*").alias("kept"))


@query("t27_settings", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(v):
    return v("events").select("event_id", text.parse_or_empty(c("props"))["k"].alias("k"))


# scoring: each document's whole text against that of the next one of its language, accents as tones

_CHARS = "regexp_extract_all({}, '(?s).')"
_PLAIN = f"translate({{}}, '{ACCENTS}', '{PLAIN}')"
_LISTS = ", ".join(_CHARS.format(x) for x in ("a", "b", _PLAIN.format("a"), _PLAIN.format("b")))
_ST = f"""pr AS (SELECT doc_id, text AS a, lead(text) OVER (PARTITION BY lang ORDER BY doc_id) AS b FROM documents),
st AS (SELECT doc_id, a, b, CASE WHEN a IS NOT NULL THEN list_transform(list_zip({_LISTS}),
  lambda x: CASE WHEN x[2] IS NULL THEN 'missing' WHEN x[1] IS NULL THEN 'extra' WHEN x[1] = x[2] THEN 'perfect' WHEN x[3] = x[4] THEN 'tone_wrong' ELSE 'wrong' END) END AS s FROM pr WHERE b IS NOT NULL)"""


def _pairs(v):
    p = seq.following(v("documents").select("doc_id", "lang", c("text").alias("a")), "lang", "doc_id", "a")
    return p.select("doc_id", "a", c("next").alias("b")).filter("b is not null")


def _compared(v):
    p = _pairs(v).select("doc_id", F.length("a").alias("n"), F.length("b").alias("heard_n"), scoring.compare_texts(c("a"), c("b"), TONES_OFF).alias("x"))
    return p.select("doc_id", "x", scoring.score_counts(c("x.perfect"), c("x.tone_wrong"), c("n"), c("heard_n")).alias("r"))


_N1 = f"WITH {_ST} SELECT doc_id, array_to_string(s, ',') AS s FROM st"


@query("n1_status", _N1)
@query("n1_status_whole", _N1)
def _(v):
    return _pairs(v).select("doc_id", scoring.align_texts(c("a"), c("b"), TONES_OFF).alias("s"))


_SC = f"""{_ST}, sc AS (SELECT *, CASE WHEN length(a) > 0 THEN trunc(len(list_filter(s, lambda x: x IN ('perfect', 'tone_wrong'))) / length(a)::DOUBLE * 100) ELSE 0 END::INT AS pron,
  CASE WHEN length(a) > 0 THEN trunc(len(list_filter(s, lambda x: x = 'perfect')) / length(a)::DOUBLE * 100) ELSE 0 END::INT AS tone FROM st),
sx AS (SELECT *, CASE WHEN length(b) = 0 THEN 0 ELSE greatest(0, trunc(pron * 0.5 + tone * 0.5)::INT - least(20, 5 * abs(length(a) - length(b)))) END::INT AS score FROM sc)"""
_N2 = f"WITH {_SC} SELECT doc_id, pron, tone, score FROM sx"


@query("n2_score", _N2)
@query("n2_score_whole", _N2)
def _(v):
    return _compared(v).select("doc_id", "r.*")


_PICK = "array_to_string(list_transform(list_filter(list_zip(s, " + _CHARS.format("a") + "), lambda x: x[1] IN ({})), lambda x: x[2])[1:3], '')"


@query("n3_feedback", f"""WITH {_SC}, pk AS (SELECT *, {_PICK.format("'tone_wrong'")} AS tones, {_PICK.format("'wrong', 'missing'")} AS bad FROM sx)
SELECT doc_id, concat_ws(' ', CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'practise' ELSE 'again' END,
  CASE WHEN tones <> '' THEN 'tone: ' || tones END, CASE WHEN bad <> '' THEN 'wrong: ' || bad END) AS feedback FROM pk""")
def _(v):
    return _compared(v).select("doc_id", scoring.feedback_text(c("r.score"), c("x.tones"), c("x.wrong")).alias("feedback"))


def _common(pairs: str) -> str:
    """`lcs` (x, y, common) of the distinct pairs of short strings that the SQL gives, a row of the usual table at a time."""
    cell = "list_max(list_transform(range(1, j + 1), lambda k: greatest(line[k + 1], line[k] + (cb[k] = ca[i + 1])::INT)))"
    return f"""xy AS (SELECT DISTINCT x, y FROM ({pairs})),
steps AS (SELECT x, y, {_CHARS.format("x")} AS ca, {_CHARS.format("y")} AS cb, 0 AS i, list_transform(range(0, length(y) + 1), lambda j: 0) AS line FROM xy
  UNION ALL SELECT x, y, ca, cb, i + 1, list_concat([0], list_transform(range(1, len(cb) + 1), lambda j: {cell})) FROM steps WHERE i < len(ca)),
lcs AS (SELECT x, y, line[-1] AS common, CASE WHEN length(x) + length(y) = 0 THEN 1 ELSE 2 * line[-1] / (length(x) + length(y))::DOUBLE END AS ratio FROM steps WHERE i = len(ca))"""


@query("n4_edit_ratio", f"WITH RECURSIVE {_common('SELECT p_name AS x, p_type AS y FROM part')} SELECT p_partkey, ratio FROM part JOIN lcs ON x = p_name AND y = p_type")
def _(v):
    return v("part").select("p_partkey", scoring.edit_ratio(c("p_name"), c("p_type")).alias("ratio"))


@query("n5_blend", f"""WITH RECURSIVE {_common("SELECT p_name AS x, p_type AS y FROM part UNION ALL SELECT p_name, p_brand FROM part")},
b AS (SELECT p_partkey, trunc(trunc(t.ratio * 100) * 0.6::DOUBLE + trunc(r.ratio * 100) * 0.25::DOUBLE + 50 * 0.15::DOUBLE)::INT AS raw, abs(length(p_name) - length(p_type)) AS gap
  FROM part JOIN lcs t ON t.x = p_name AND t.y = p_type JOIN lcs r ON r.x = p_name AND r.y = p_brand)
SELECT p_partkey, CASE WHEN gap > 2 THEN greatest(0, raw - least(15, 2 * gap)) ELSE raw END::INT AS score FROM b""")
def _(v):
    s = lambda x: (scoring.edit_ratio(c("p_name"), x) * 100).cast("int")
    return v("part").select("p_partkey", scoring.blend_score(s(c("p_type")), s(c("p_brand")), lit(50), F.abs(F.length("p_name") - F.length("p_type"))).alias("score"))


@query("n6_word_status", f"""WITH RECURSIVE nx AS (SELECT conv_id, turn, string_split_regex(text, ' +') AS a, string_split_regex(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ' +') AS b FROM conversations),
places AS (SELECT conv_id, turn, a, b, unnest(range(1, greatest(len(a), len(b)) + 1)) AS i FROM nx WHERE b IS NOT NULL),
w AS (SELECT conv_id, turn, i, a[i] AS x, b[i] AS y FROM places), {_common("SELECT x, y FROM w WHERE x <> y")}
SELECT conv_id, turn, string_agg(CASE WHEN w.y IS NULL THEN 'missing' WHEN w.x IS NULL THEN 'extra' WHEN w.x = w.y THEN 'perfect' WHEN ratio >= 0.6::DOUBLE THEN 'similar' ELSE 'wrong' END, ',' ORDER BY w.i) AS status
FROM w LEFT JOIN lcs USING (x, y) GROUP BY 1, 2""")
def _(v):
    nxt = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    words = lambda x: F.split(x, " +")
    df = v("conversations").select("conv_id", "turn", "text", nxt.alias("heard")).filter("heard is not null")
    return df.select("conv_id", "turn", F.array_join(scoring.word_status(words(c("text")), words(c("heard"))), ",").alias("status"))


_PIECES = """pc AS (SELECT p_partkey, t, unnest(ps) AS piece, unnest(range(1, len(ps) + 1)) AS index FROM (SELECT p_partkey, p_brand AS t,
  list_filter(list_transform(range(0, ceil(length(h) / length(p_brand)::DOUBLE)::INT), lambda i: substr(h, (i * length(p_brand) + 1)::INT, length(p_brand)::INT)), lambda x: length(x) >= greatest(2, length(p_brand) - 1)) AS ps
  FROM (SELECT *, {heard} AS h FROM part) WHERE length(p_brand) >= 2 AND length(h) >= 1.5 * length(p_brand)) WHERE len(ps) > 1)"""


@query("n7_repeats", f"WITH {_PIECES.format(heard='p_brand || p_brand || p_name')} SELECT p_partkey, piece FROM pc")
def _(v):
    df = v("part").select("p_partkey", F.explode(scoring.split_repeats(c("p_brand"), F.concat("p_brand", "p_brand", "p_name"))).alias("piece"))
    return df


# signals


_SERIES = "x AS (SELECT *, max(idx) OVER (PARTITION BY series_id) + 1 AS n, abs(sign(value - 100) - lag(sign(value - 100)) OVER (PARTITION BY series_id ORDER BY idx)) AS turn FROM series_v)"


@query("g1_windows", f"WITH {_SERIES} SELECT series_id, k * 5 AS start, round(sqrt(avg((value - 100) ** 2)), 6) AS rms, round(sum(CASE WHEN idx > k * 5 THEN turn ELSE 0 END) / 40.0, 6) AS zcr FROM x JOIN range(0, 100000) AS r(k) ON idx >= k * 5 AND idx < k * 5 + 20 AND k * 5 < n - 20 AND k <= n // 5 GROUP BY 1, 2")
def _(v):
    df = sig.window_features(v("series_v").withColumn("value", c("value") - 100), 20, 5)
    return df.select("series_id", "start", F.round("rms", 6).alias("rms"), F.round("zcr", 6).alias("zcr"))


@query("g2_gate", "SELECT event_id FROM events WHERE value >= 5 AND value / 1000 <= 0.3")
def _(v):
    return sig.gate(v("events").withColumns({"rms": c("value"), "zcr": c("value") / 1000}), 5.0, 0.3).select("event_id")


@query("g3_trim_tail", """WITH n AS (SELECT series_id, (max(idx) + 1) // 4 AS frames FROM series_v GROUP BY 1),
f AS (SELECT series_id, frames, idx // 4 AS f, sqrt(avg(value * value)) AS e FROM series_v JOIN n USING (series_id) WHERE idx // 4 < frames GROUP BY ALL),
t AS (SELECT series_id, avg(e) * 0.05 AS floor FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY e DESC, f) AS r FROM f) WHERE r <= greatest(1, frames // 4) GROUP BY 1),
z AS (SELECT series_id, frames, max(f) AS f FROM f JOIN t USING (series_id) WHERE e >= floor GROUP BY ALL)
SELECT s.series_id, count(*) AS n FROM series_v s LEFT JOIN z ON z.series_id = s.series_id WHERE z.f IS NULL OR frames < 3 OR s.idx < (z.f + 1) * 4 + 8 GROUP BY 1""")
def _(v):
    return sig.trim_tail(v("series_v"), 4, 8).groupBy("series_id").agg(F.count("*").alias("n"))


_PEAK = "SELECT series_id, idx, round(CASE WHEN p > 0 THEN (value - m) / p * 0.7 ELSE 0 END, 6) AS value FROM (SELECT *, greatest(hi - m, m - lo) AS p FROM (SELECT *, avg(value) OVER w AS m, max(value) OVER w AS hi, min(value) OVER w AS lo FROM series_v WINDOW w AS (PARTITION BY series_id)))"


@query("g4_peak", _PEAK)
def _(v):
    return sig.normalize_peak(v("series_v")).select("series_id", "idx", F.round("value", 6).alias("value"))


@query("g5_resample", "WITH n AS (SELECT series_id, max(idx) + 1 AS n, floor((max(idx) + 1) * 2 ** (-3 / 12.0))::BIGINT AS m FROM series_v GROUP BY 1), g AS (SELECT *, unnest(range(0, m)) AS o FROM n), x AS (SELECT *, CASE WHEN m > 1 THEN o * ((n - 1) / (m - 1)::DOUBLE) ELSE 0 END AS x FROM g), y AS (SELECT *, least(floor(x), n - 1)::BIGINT AS pos FROM x) SELECT y.series_id, o AS idx, round(a.value + (coalesce(b.value, a.value) - a.value) * (x - pos) + 1e-8, 6) AS value FROM y JOIN series_v a ON a.series_id = y.series_id AND a.idx = pos LEFT JOIN series_v b ON b.series_id = y.series_id AND b.idx = pos + 1")
def _(v):
    return sig.resample_linear(v("series_v"), 3).select("series_id", "idx", F.round(c("value") + 1e-8, 6).alias("value"))


@query("g6_cluster")
def _(v):
    e = v("embeddings").withColumn("recording", F.floor(c("vec_id") / 64))  # 64 segments each
    return sig.cluster(e, "recording", "vec_id", "embedding")


@query("g7_speaker_report")
def _(v):
    return sig.speaker_report(v("segments_v"))


# maintenance


@query("m1_upsert", "WITH ch AS (SELECT c_custkey + 100 AS k, c_name AS s FROM customer WHERE c_custkey % 2 = 0) SELECT coalesce(c_custkey, k) AS user_id, CASE WHEN k IS NOT NULL THEN s ELSE c_mktsegment END AS settings FROM customer FULL JOIN ch ON c_custkey = k")
def _(v):
    base = v("customer").select(c("c_custkey").alias("user_id"), c("c_mktsegment").alias("settings"))
    ch = v("customer").filter("c_custkey % 2 = 0").select((c("c_custkey") + 100).alias("user_id"), c("c_name").alias("settings"), c("c_acctbal").alias("at"))
    return mt.upsert(base, ch, ["user_id"], ["settings"], "at")


@query("m2_backfill", "SELECT id, CASE WHEN level <= 10 AND plan = 'BUILDING' THEN 'max' ELSE plan END AS plan FROM users_v")
def _(v):
    return mt.backfill(v("users_v"), {"plan": [((c("level") <= 10) & (c("plan") == "BUILDING"), lit("max"))]}).select("id", "plan")


@query("m3_decisions", "SELECT id, CASE WHEN status <> 'pending' THEN status WHEN id % 3 = 0 THEN 'approved' WHEN id % 3 = 1 THEN 'rejected' ELSE status END AS status FROM reviews_v")
def _(v):
    r = v("reviews_v").withColumns({"reviewed_by": lit(None).cast("long"), "review_note": lit(None).cast("string"), "reviewed_at": lit(None).cast("timestamp_ntz")})
    d = r.filter("status = 'pending' and id % 3 < 2").select(c("id").alias("review_id"), (c("id") % 3 == 0).alias("approve"), lit(1).cast("long").alias("reviewer"), lit("ok").alias("note"), F.to_timestamp_ntz(lit(NOW)).alias("at"))
    voices = v("voices_v").withColumns({"status": lit("review"), "can_generate": lit(0)})
    return mt.apply_decisions(voices, r, d)[1].select("id", "status")


@query("m4_versions", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size + 1 ELSE p_size END AS v, CASE WHEN p_size > 25 THEN 'published' ELSE p_brand END AS status FROM part")
def _(v):
    p = v("part").select("p_partkey", c("p_size").alias("v"), c("p_brand").alias("status"))
    return mt.bump_version(p, p.filter("v > 25"), "p_partkey", "v")


@query("m5_copies", """WITH r AS (SELECT id AS sid, CASE WHEN id % 2 = 0 THEN 'personal' ELSE 'shared' END AS kind, row_number() OVER (ORDER BY id) AS k FROM voices_v WHERE id % 5 = 0)
SELECT id, name, shared_folder_id::BIGINT AS shared_folder_id, folder_type, 'review' AS status, id % 7 AS user_id, '2023-01-01' AS created_at, NULL::BIGINT AS source_voice_id FROM voices_v UNION ALL
SELECT (SELECT max(id) FROM voices_v) + k, CASE WHEN kind = 'personal' THEN name || ' (copy)' ELSE name END, CASE WHEN kind = 'shared' THEN sid + 1000 END, kind, 'active', sid + 50, '2024-01-15', sid FROM r JOIN voices_v ON id = sid""")
def _(v):
    voices = v("voices_v").withColumns({"status": lit("review"), "user_id": c("id") % 7, "created_at": lit("2023-01-01"), "shared_folder_id": c("shared_folder_id").cast("long")})
    asked = voices.filter("id % 5 = 0").select(c("id").alias("source_id"), F.when(c("id") % 2 == 0, "personal").otherwise("shared").alias("kind"), (c("id") + 50).alias("user_id"), (c("id") + 1000).alias("folder_id"), lit("2024-01-15").alias("at"))
    return mt.copy_rows(voices, asked)


@query("m6_toggle", "SELECT id, CASE WHEN user_id % 2 = 0 THEN 1 - is_starred::INT ELSE is_starred::INT END AS is_starred FROM records_v")
def _(v):
    r = v("records_v").withColumn("is_starred", c("is_starred").cast("int"))
    return mt.toggle(r, r.filter("user_id % 2 = 0").select("id"), "id", "is_starred").select("id", "is_starred")


@query("m7_replace_slice", "SELECT id, category FROM cards_v WHERE NOT coalesce(category = 'ECONOMY BRASS', false) UNION ALL SELECT id + 1000000, 'new' FROM cards_v WHERE category = 'ECONOMY BRASS'")
def _(v):
    k = v("cards_v").select("id", "category")
    new = k.filter("category = 'ECONOMY BRASS'").select((c("id") + 1000000).alias("id"), lit("new").alias("category"))
    return mt.replace_slice(k, new, c("category") == "ECONOMY BRASS")


@query("m8_scores", "SELECT event_id, json_extract_string(props, '$.k')::INT AS score, 1 AS index FROM events UNION ALL SELECT event_id, 0, 2 FROM events")
def _(v):
    j = F.concat(lit('[{"text":"a","index":1,"score":'), F.get_json_object("props", "$.k"), lit('},{"text":"b","index":2}]'))
    return mt.explode_scores(v("events").withColumn("j", j), "event_id", "j").select("event_id", "score", "index")


@query("m9_folders", "SELECT folder_id, user_id, permission FROM members_v UNION ALL SELECT id + 100, owner_id, 'admin' FROM folders_v")
def _(v):
    new = v("folders_v").withColumn("id", (c("id") + 100).cast("int"))
    return mt.create_folders(v("folders_v"), v("members_v"), new)[1]


# the parts of operators that the queries above leave out, and sinks and streams written and read back


@query("s1_typed_scan", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def _(v):
    kind = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.LongType())])
    return src.conform(v("nation"), kind)


@query("s8_split_properties", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, true AS share_ok, round(sum(n_chars), 2)::DOUBLE AS total FROM documents")
def _(v):
    train, test, total = src.train_eval_split(v("documents").select("doc_id", c("n_chars").cast("double").alias("n_chars")), "doc_id", "n_chars")
    both = train.withColumn("e", lit(0)).unionByName(test.withColumn("e", lit(1)))
    return both.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.avg("e").between(0.08, 0.22).alias("share_ok")).withColumn("total", lit(total))


@query("s9_subtitle_text", f"""WITH {_CUES}, codes AS (SELECT doc_id, i, text, start + 1e-6 AS a, greatest("end", 0.0) + 1e-6 AS b FROM cue),
coded AS (SELECT doc_id, i, (i + 1) || chr(10) || {{}} || ' --> ' || {{}} || chr(10) || text || chr(10) AS piece FROM codes) SELECT doc_id, string_agg(piece, chr(10) ORDER BY i) AS srt FROM coded GROUP BY 1""".format(*(f"printf('%02d:%02d:%02d,%03d', floor({x})::BIGINT // 3600, (floor({x})::BIGINT % 3600) // 60, floor({x})::BIGINT % 60, floor(({x} - floor({x})) * 1000)::BIGINT)" for x in "ab")))
def _(v):
    at = lambda x: text.timecode(x + 1e-6)  # noqa: E731  sums of doubles, in whatever order, are on one side of a millisecond then
    return src.render_srt(_cue_rows(v).withColumn("start_code", at(c("start"))).withColumn("end_code", at(F.greatest("end", lit(0.0)))))


@query("p1_all_viewers", "SELECT v.id AS viewer_id, count(*) AS n, sum(r.id)::BIGINT AS ids FROM users_v v JOIN results_v r ON v.level <= 10 OR r.voice_id = v.id GROUP BY 1")
def _(v):
    totals = lambda df: df.agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
    seen = rel.scopes(v("results_v"), v("users_v"), "voice_id")
    own = totals(seen.filter("not sees_all").groupBy("viewer_id"))
    whole = seen.filter("sees_all").select("viewer_id").crossJoin(totals(v("results_v")).filter("n > 0"))  # one row
    return own.unionByName(whole)


_OWNED = "SELECT id, id % 40 AS user_id, category, chinese, subject FROM cards_v"


@query("a1_visible_cards", f"""WITH k AS ({_OWNED}), s AS (SELECT *, coalesce(category IN ('ECONOMY BRASS', 'STANDARD STEEL'), false) AS sh FROM k),
r AS (SELECT user_id, count(*) AS attempts, round(coalesce(avg(CASE WHEN score > 0 THEN score END), 0), 1) AS avg_score, count(*) FILTER (is_starred) AS starred, count(*) FILTER ((created_at + INTERVAL 9 HOURS)::DATE = (TIMESTAMP '{NOW}' + INTERVAL 9 HOURS)::DATE) AS today FROM records_v GROUP BY 1),
u AS (SELECT user_id FROM r UNION SELECT user_id FROM s WHERE NOT sh)
SELECT user_id, coalesce(attempts, 0) AS attempts, coalesce(avg_score, 0) AS avg_score, coalesce(starred, 0) AS starred, coalesce(today, 0) AS today, (SELECT count(*) FROM s WHERE s.sh OR s.user_id = u.user_id) AS total_cards FROM u LEFT JOIN r USING (user_id)""")
def _(v):
    cards = v("cards_v").withColumn("user_id", c("id") % 40)
    return rel.study_stats(v("records_v"), NOW, cards, shared=("ECONOMY BRASS", "STANDARD STEEL"))


@query("a9_id_lists", """WITH g AS (SELECT l_orderkey AS group_id, round(sum(p_retailprice / 100), 4) AS seconds, arg_min(p_name, pos) AS name FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT *, CASE WHEN seconds < 30 THEN 'reject' WHEN seconds < 120 THEN 'warn' ELSE 'ok' END AS verdict FROM g""")
def _(v):
    one = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    lists = v("lineitem").groupBy("l_orderkey").agg(F.concat(lit(" ,"), F.array_join(F.transform(one, lambda x: x["l_partkey"].cast("string")), " , "), lit(",,")).alias("ids"))
    voices = v("part").select(c("p_partkey").alias("voice_id"), c("p_name").alias("name"), (c("p_retailprice") / 100).alias("duration"))
    return rel.training_eligibility(rel.chosen_voices(lists, "l_orderkey", "ids"), voices).withColumn("seconds", F.round("seconds", 4))


@query("w10_totals", "SELECT l_orderkey, round(sum(l_quantity) + 0.2 * (count(*) - 1), 6) AS total, round(sum(l_quantity) + 0.15 * count(*), 6) AS with_tail FROM lineitem GROUP BY 1")
def _(v):
    parts, clause = _parts(v), seq.timeline_totals(_parts(v), "l_orderkey", 0.15, True).withColumnRenamed("total", "with_tail")
    both = seq.timeline_totals(parts, "l_orderkey", 0.2).join(clause, "l_orderkey")
    return both.select("l_orderkey", F.round("total", 6).alias("total"), F.round("with_tail", 6).alias("with_tail"))


@query("w11_numbering", f"""WITH {_SEGS}, h AS (SELECT speaker, i, 0 AS half, start, CASE WHEN i % 2 = 0 AND "end" > start THEN (start + "end") / 2 ELSE "end" END AS "end" FROM sg UNION ALL SELECT speaker, i, 1, (start + "end") / 2, "end" FROM sg WHERE i % 2 = 0 AND "end" > start)
SELECT speaker, (row_number() OVER (PARTITION BY speaker ORDER BY i, half) - 1)::INT AS index, round(start, 6) AS start, round("end", 6) AS "end" FROM h""")
def _(v):
    s = v("segments_v").withColumn("i", F.row_number().over(Window.partitionBy("speaker").orderBy("start", "event_id"))).select("speaker", "i", "start", "end")
    cuts = s.filter("i % 2 = 0").select("speaker", "i", ((c("start") + c("end")) / 2).alias("cut"))
    return seq.split_item(s, cuts, "speaker", "i").select("speaker", c("index").cast("int").alias("index"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def _reviewed(v):
    """Two decisions on some reviews, and new requests after them."""
    r = v("reviews_v").withColumns({"reviewed_by": lit(None).cast("long"), "review_note": lit(None).cast("string"), "reviewed_at": lit(None).cast("int"), "created_at": lit(0)})
    pending = r.filter("status = 'pending'")
    decide = lambda when, approve, at: pending.filter(when).select(c("id").alias("review_id"), approve.alias("approve"), lit(1).cast("long").alias("reviewer"), lit("ok").alias("note"), lit(at).alias("at"))
    d = decide("id % 3 < 2", c("id") % 3 == 0, 1).unionByName(decide("id % 6 = 0", lit(False), 2))
    asked = v("voices_v").filter("id % 7 = 0").select((c("id") + 10**9).alias("id"), c("id").alias("voice_id"), c("shared_folder_id").cast("long").alias("shared_folder_id"), lit(5).cast("long").alias("requested_by"), lit(3).alias("at"))
    return mt.apply_decisions(v("voices_v").withColumns({"status": lit("active"), "can_generate": lit(0)}), r, d, asked)


@query("m3_voices", """WITH ev AS (SELECT voice_id, id AS n, 1 AS moment, CASE WHEN id % 3 = 0 THEN 'published' ELSE 'active' END AS state FROM reviews_v WHERE status = 'pending' AND id % 3 < 2
UNION ALL SELECT voice_id, id, 2, 'active' FROM reviews_v WHERE status = 'pending' AND id % 6 = 0 UNION ALL SELECT id, id + 1000000000, 3, 'review' FROM voices_v WHERE id % 7 = 0),
d AS (SELECT voice_id, arg_max(state, (moment, n)) AS state, bool_or(state = 'published') AS ok FROM ev GROUP BY 1)
SELECT v.id, v.name, coalesce(state, 'active') AS status, CASE WHEN ok THEN 1 ELSE 0 END AS can_generate, CASE WHEN ok THEN 'published' ELSE folder_type END AS folder_type FROM voices_v v LEFT JOIN d ON d.voice_id = v.id""")
def _(v):
    return _reviewed(v)[0].select("id", "name", "status", "can_generate", "folder_type")


@query("m3_requests", """SELECT id, voice_id, requested_by, shared_folder_id::BIGINT AS shared_folder_id, CASE WHEN status <> 'pending' OR id % 3 = 2 THEN status WHEN id % 6 = 0 OR id % 3 = 1 THEN 'rejected' ELSE 'approved' END AS status,
CASE WHEN status = 'pending' AND id % 3 < 2 THEN 1 END::BIGINT AS reviewed_by, CASE WHEN status = 'pending' AND id % 3 < 2 THEN CASE WHEN id % 6 = 0 THEN 2 ELSE 1 END END::INT AS reviewed_at, 0 AS created_at FROM reviews_v
UNION ALL SELECT id + 1000000000, id, 5, shared_folder_id, 'pending', NULL, NULL, 3 FROM voices_v WHERE id % 7 = 0""")
def _(v):
    return _reviewed(v)[1].select("id", "voice_id", "requested_by", c("shared_folder_id").cast("long").alias("shared_folder_id"), "status", "reviewed_by", "reviewed_at", "created_at")


@query("m9_folder_table", "SELECT id::INT AS id, name, owner_id FROM folders_v UNION ALL SELECT (id + 100)::INT, name, owner_id FROM folders_v")
def _(v):
    new = v("folders_v").withColumn("id", (c("id") + 100).cast("int"))
    return mt.create_folders(v("folders_v"), v("members_v"), new)[0].select("id", "name", "owner_id")


@query("t26_section_lines", r"""WITH l AS (SELECT pdf, max(page) AS last_page FROM lines_v GROUP BY 1), s AS (SELECT pdf, last_page, unnest(range(0, last_page // 100 + 1)) AS section FROM l),
n AS (SELECT pdf, page, line_no, trim(line, ' ') AS line FROM lines_v)
SELECT pdf, section, page, line_no::INT AS line_no, md5(line) AS line, 151::BIGINT AS page_count FROM n JOIN s USING (pdf) WHERE page BETWEEN section * 100 AND least(section * 100 + 150, last_page) AND length(line) >= 3 AND NOT regexp_matches(line, '^\d+$') AND NOT contains(line, 'License')""")
def _(v):
    last = v("lines_v").groupBy("pdf").agg(F.max("page").alias("last_page"))
    sections = last.select("pdf", F.explode(F.sequence(lit(0).cast("long"), F.floor(c("last_page") / 100))).alias("section"))
    sections = sections.withColumns({"start_page": c("section") * 100, "end_page": c("section") * 100 + 150})
    return rel.section_lines(v("lines_v"), sections, 3, ("License",)).select("pdf", "section", "page", "line_no", F.md5("line").alias("line"), "page_count")


@query("n7_repeat_scores", f"""WITH {_PIECES.format(heard="p_brand || upper(p_brand) || p_name")},
k AS (SELECT *, length(t)::INT AS n, length(piece)::INT AS m, list_filter(range(1, least(length(t), length(piece)) + 1), lambda i: lower(t[i]) = lower(piece[i])).len() AS p, list_filter(range(1, least(length(t), length(piece)) + 1), lambda i: t[i] = piece[i]).len() AS q FROM pc),
x AS (SELECT *, trunc(p / n::DOUBLE * 100)::INT AS pron, trunc(q / n::DOUBLE * 100)::INT AS tone FROM k)
SELECT p_partkey, index::INT AS index, piece AS text, pron, tone, greatest(0, trunc(pron * 0.5 + tone * 0.5)::INT - least(20, 5 * abs(n - m)))::INT AS score FROM x""")
def _(v):
    heard = F.concat("p_brand", F.upper("p_brand"), "p_name")
    return v("part").select("p_partkey", F.explode(scoring.score_repeats(c("p_brand"), heard, F.lower)).alias("s")).select("p_partkey", "s.*")


@query("g7_diarized")
def _(v):
    e = v("embeddings").withColumn("recording", F.floor(c("vec_id") / 64)).join(v("segments_v"), c("vec_id") == c("event_id"))
    return sig.diarized_report(e.select("recording", "vec_id", "embedding", "start", "end", "energy"), "recording", "vec_id", "embedding")


def _terms(v):
    """Words of the part names as terms, their brand as gloss."""
    return v("part").select(F.explode(F.split("p_name", " ")).alias("term"), c("p_brand").alias("gloss")).filter("term <> ''")


_TERMS = """terms AS (SELECT term, min(p_brand) AS gloss FROM (SELECT unnest(string_split(p_name, ' ')) AS term, p_brand FROM part) WHERE term <> '' GROUP BY 1),
dict AS MATERIALIZED (SELECT map_from_entries(list((term, gloss))) AS m FROM terms)"""


def _walk_sql(name: str) -> str:
    """Longest matches of up to six characters, one a step, over the texts `t` of a view."""
    return f"""walk AS (SELECT id, t, 1 AS i, []::VARCHAR[] AS out FROM {name} UNION ALL
  SELECT id, t, i + coalesce(k, 1), list_append(out, coalesce(m[t[i:i + k - 1]], t[i])) FROM (
    SELECT w.*, m, list_filter(range(6, 0, -1), lambda k: i + k - 1 <= length(t) AND map_contains(m, t[i:i + k - 1]))[1] AS k FROM walk w, dict WHERE i <= length(t))),
walked AS (SELECT id, array_to_string(out, '; ') AS s FROM walk WHERE i > length(t))"""


@query("j8_gloss_pieces", rf"""WITH RECURSIVE {_TERMS}, cl AS (SELECT p_partkey AS id, regexp_replace(p_name, '[，。！？、；：\s,.!?]', '', 'g') AS t FROM part), {_walk_sql("cl")}
SELECT id AS p_partkey, coalesce(CASE WHEN g.gloss <> '' THEN g.gloss END, CASE WHEN length(t) >= 2 AND regexp_matches(t, '[a-z]') THEN s END) AS gloss FROM cl LEFT JOIN walked USING (id) LEFT JOIN terms g ON g.term = t""")
def _(v):
    return rel.gloss(v("part").select("p_partkey", "p_name"), "p_name", _terms(v), "a-z").select("p_partkey", "gloss")


@query("t11_dictionary", f"""WITH RECURSIVE {_TERMS}, cl AS (SELECT p_partkey AS id, p_name AS t FROM part), {_walk_sql("cl")} SELECT id AS p_partkey, s AS segmented FROM walked""")
def _(v):
    return segmentation.segmented(v("part").select("p_partkey", "p_name"), "p_name", _terms(v), "segmented").select("p_partkey", "segmented")


#: every known run of up to four words, then a fold over the words: where the next piece starts, and the starts so far
@query("t10_dictionary", rf"""WITH d AS (SELECT doc_id, translate(text, 'áéíóú', 'áéíóǔ') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(trim(t, ' '), '[\t-\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+'), lambda x: x <> '') AS w FROM d),
words AS (SELECT DISTINCT unnest(w) AS term FROM w), toned AS (SELECT * FROM w WHERE regexp_matches(t, '[{text.TONE_VOWELS}]')),
run AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], '') AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM toned), range(1, 5) x(k) WHERE i + k - 1 <= len(w)),
longest AS (SELECT doc_id, i, max(k) AS k, arg_max(r, k) AS r FROM run JOIN words ON term = r GROUP BY ALL),
per AS (SELECT doc_id, list([i, k] ORDER BY i) AS ks, list(r ORDER BY i) AS rs FROM longest GROUP BY 1),
starts AS (SELECT doc_id, rs, list_reduce(list_prepend([1::BIGINT], ks), lambda a, e: CASE WHEN e[1] = a[1] THEN list_append(list_prepend(e[1] + e[2], a[2:]), e[1]) ELSE a END)[2:] AS s FROM per),
back AS (SELECT doc_id, array_to_string(list_transform(s, lambda i: translate(rs[i], '{ACCENTS}', '{PLAIN}')), '') AS segmented FROM starts)
SELECT doc_id, coalesce(segmented, t) AS segmented FROM d LEFT JOIN back USING (doc_id)""")
def _(v):
    """Words with an accent of one turn, toned or not, replaced by their language-free form."""
    df = v("documents").select("doc_id", F.translate("text", "áéíóú", "áéíóǔ").alias("text"))
    # the count is looked at, so words are told apart before their glosses are made; a distinct alone would be dropped under the minimum
    words = df.select(F.explode(text.tokens(c("text"))).alias("term")).groupBy("term").count().filter("count > 0").select("term", plain(c("term")).alias("gloss"))
    return segmentation.words_of_syllables(df, "text", words, "segmented").select("doc_id", "segmented")


def _written(name: str, sql: str):
    """Registers a query that writes to a new shared folder and reads it back: a function of (spark, view, path)."""

    def put(f):
        QUERIES[name] = lambda spark, d: f(spark, lambda n: view(spark, d, n), d, src.new_folder(spark, name))
        SQL[name] = with_views(sql)
        return f

    return put


@_written("s4_sections", "SELECT n_name AS pdf, n_name AS title, n_regionkey::BIGINT AS week, n_nationkey::BIGINT AS start_page, (n_nationkey + 9)::BIGINT AS end_page FROM nation")
def _(spark, v, d, path):
    one = F.struct(c("n_name").alias("pdf"), c("n_name").alias("title"), c("n_regionkey").alias("week"), c("n_nationkey").alias("start_page"), (c("n_nationkey") + 9).alias("end_page"))
    v("nation").agg(F.to_json(F.collect_list(one)).alias("value")).write.text(path)  # an index of sections is a small file
    return src.read_sections(spark, path).select("pdf", "title", "week", "start_page", "end_page")


@_written("s1_read_table", "SELECT n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def _(spark, v, d, path):
    return src.read_table(spark, d, "nation", "n_name string, n_regionkey bigint")


@_written("s8_manifest", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, sum(n_chars)::BIGINT AS chars, true AS total_ok, true AS both FROM documents")
def _(spark, v, d, path):
    """The two parts as written, read back."""
    out = src.write_manifest(v("documents").select("doc_id", "n_chars"), path, "doc_id", "n_chars")
    part = lambda k: spark.read.schema("doc_id bigint, n_chars bigint").csv(out[k], header=True).withColumn("part", lit(k))
    df = part("train_csv").unionByName(part("eval_csv"))
    both = F.count_distinct("part") == 2
    return df.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), F.sum("n_chars").alias("chars"), (F.sum("n_chars") == lit(int(out["total_duration"]))).alias("total_ok"), both.alias("both"))


@_written("s5_dictionary", "SELECT '' AS part, n_name AS term, n_regionkey::VARCHAR AS gloss FROM nation UNION ALL SELECT 'syllable', r_name, r_regionkey::VARCHAR FROM region")
def _(spark, v, d, path):
    pairs = lambda df, k, x: df.agg(F.map_from_entries(F.collect_list(F.struct(c(k), c(x).cast("string")))).alias("m"))
    pairs(v("nation"), "n_name", "n_regionkey").select(F.to_json("m").alias("value")).write.text(f"{path}/flat")
    pairs(v("region"), "r_name", "r_regionkey").select(F.to_json(F.create_map(lit("syllable"), "m")).alias("value")).write.text(f"{path}/nested")
    return src.read_dictionary(spark, f"{path}/flat").unionByName(src.read_dictionary(spark, f"{path}/nested"))


@_written("s6_by_day", "SELECT event_id, strftime(ts, '%Y%m%d') AS day FROM events")
def _(spark, v, d, path):
    src.write_by_day(v("events").select("event_id", "ts"), path, "ts")
    return spark.read.schema("event_id bigint, ts timestamp_ntz, day string").parquet(path).select("event_id", "day")


@_written("s7_log", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT user_id, -count(*) FROM events GROUP BY 1")
def _(spark, v, d, path):
    n = v("events").groupBy("user_id").agg(F.count("*").alias("n"))
    src.append_log(n, path)
    src.append_log(n.withColumn("n", -c("n")), path)
    return spark.read.schema("user_id bigint, n bigint").json(path)


def _stream(spark, d, name):
    """A table's file as a stream, some files a batch."""
    path = f"{d}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(path[:-1] + "[t]")


def _ran(stream, path: str) -> None:
    stream.trigger(availableNow=True).option("checkpointLocation", f"{path}/state").start().awaitTermination()


@_written("r1_running_feedback", "SELECT checkpoint_id, avg(score) AS avg_score, count(*) AS n FROM feedback_v WHERE checkpoint_id <> 0 GROUP BY 1")
def _(spark, v, d, path):
    e = _stream(spark, d, "events").select(F.get_json_object("props", "$.k").cast("int").alias("checkpoint_id"), F.when(c("event_type") == "error", -1).otherwise(1).alias("score"))
    _ran(running.running_feedback(e).writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")), path)
    return spark.read.parquet(f"{path}/out")


@_written("r2_running_days", "SELECT user_id, (created_at + INTERVAL 9 HOURS)::DATE AS day, count(*) AS n, round(avg(score), 1) AS avg_score, max(score) AS max_score FROM records_v GROUP BY 1, 2")
def _(spark, v, d, path):
    r = _stream(spark, d, "events").select("user_id", F.floor("value").cast("int").alias("score"), c("ts").alias("created_at"))
    _ran(running.running_days(r, "3650 days").writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{path}/out")), path)
    return spark.read.parquet(f"{path}/out")


@_written("r2_closed_days", """WITH a AS (SELECT *, least(4, date_diff('day', (SELECT min(created_at) FROM records_v), created_at) // 6) + CASE WHEN id % 10 = 0 THEN 2 ELSE 0 END AS load, (created_at + INTERVAL 9 HOURS)::DATE AS day FROM records_v),
m AS (SELECT load, max(max(created_at)) OVER (ORDER BY load) - INTERVAL 1 DAY AS mark FROM a GROUP BY load),
x AS (SELECT a.*, day + INTERVAL 15 HOURS AS stop, coalesce(m.mark, TIMESTAMP '1970-01-01') AS mark FROM a LEFT JOIN m ON m.load = a.load - 1)
SELECT user_id, day, count(*) FILTER (stop > mark) AS n, round(avg(score) FILTER (stop > mark), 1) AS avg_score, max(score) FILTER (stop > mark) AS max_score, count(*) FILTER (stop <= mark) AS late
FROM x WHERE stop <= (SELECT max(mark) FROM m) GROUP BY 1, 2 HAVING n > 0""")
def _(spark, v, d, path):
    """The attempts arrive in loads of six days, a tenth of them two loads late; a run of the stream for each load, as a scheduled job. Days go out once, when the watermark has passed them."""
    r = v("records_v").select("id", "user_id", "score", "created_at")
    first = r.agg(F.min("created_at").alias("m")).first()["m"]
    load = F.least(lit(4), F.floor(F.datediff("created_at", lit(first)) / 6)) + F.when(c("id") % 10 == 0, 2).otherwise(0)
    r.withColumn("load", load).write.partitionBy("load").parquet(f"{path}/loads")
    for i in range(7):
        arrived = spark.read.parquet(f"{path}/loads").filter(c("load") == i).drop("load")
        arrived.write.mode("append").parquet(f"{path}/arrived")
        stream = spark.readStream.schema(arrived.schema).parquet(f"{path}/arrived")
        _ran(running.running_days(stream, "1 day").writeStream.outputMode("append").format("parquet").option("path", f"{path}/days"), path)
    return running.late_attempts(r, spark.read.parquet(f"{path}/days"))


@_written("r3_upserts", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, v, d, path):
    _ran(running.upsert_sink(_stream(spark, d, "events").select("user_id", "event_type", "event_id"), f"{path}/table", ["user_id"], "event_id"), path)
    return running.read_versions(spark, f"{path}/table").select("user_id", "event_type", "event_id")
