"""Filters, joins and aggregates of the learning-data tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.segmentation import BOUND, segmented
from voxlake.functions.text import HAN, has_script
from voxlake.sources.tables import local_day

SHARED = ("textbook", "pronunciation")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# filters


def every_pair(left: DataFrame, right: DataFrame) -> DataFrame:
    """Each row of `left` with each of `right`, where that is the result asked for.

    `right` is repeated once for each shuffle partition and `left` dealt over these, so the pairs are made in all tasks and
    neither side goes whole to one; Spark broadcasts `right` if its size allows.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.withColumn("_deal", F.pmod(F.xxhash64(*left.columns), F.lit(n)))
    return dealt.join(right.withColumn("_deal", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))), "_deal").drop("_deal")


def owner_scope(df: DataFrame, viewers: DataFrame, owner: str) -> DataFrame:
    """Every (viewer, row) that a viewer sees: all rows up to level 10, else the own ones."""
    v = viewers.select(F.col("id").alias("viewer_id"), "level")
    own = df.join(v.filter("level > 10"), df[owner] == v["viewer_id"])
    return own.unionByName(every_pair(df, v.filter("level <= 10"))).drop("level")


def scopes(df: DataFrame, viewers: DataFrame, owner: str) -> DataFrame:
    """As `owner_scope`, but a viewer who sees all rows has one row with `sees_all` and nulls, not a row for each."""
    v = viewers.select(F.col("id").alias("viewer_id"), (F.col("level") <= 10).alias("sees_all"))
    own = df.join(v.filter("not sees_all"), df[owner] == v["viewer_id"])
    return own.unionByName(v.filter("sees_all"), allowMissingColumns=True)


def visible_cards(cards: DataFrame, user: Column, owner: str = "user_id", shared: tuple = SHARED) -> DataFrame:
    return cards.filter((F.col(owner) == user) | F.coalesce(F.col("category").isin(*shared), F.lit(False)))


def text_search(df: DataFrame, col: str, q: str, wildcards: bool = True) -> DataFrame:
    """Substring search that folds ASCII case only; with `wildcards`, % and _ in `q` match any text and any character."""
    low = F.translate(col, UPPER, LOWER)
    q = q.translate(str.maketrans(UPPER, LOWER))
    return df.filter(low.like("%" + q.replace("\\", "\\\\") + "%") if wildcards else low.contains(q))


def optional_filters(df: DataFrame, **equal) -> DataFrame:
    for name, value in equal.items():
        if value not in (None, "") and not (name == "week" and value <= 0):
            df = df.filter(F.col(name) == value)
    return df


def pending_work(df: DataFrame, subjects: list, subject: str, out_col: str, text_col: str) -> DataFrame:
    todo = F.col(out_col).isNull() | (F.col(out_col) == "")
    return df.filter(F.col(subject).isin(subjects) & todo & (F.length(text_col) >= 1))


def lookup(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_semi")


def on_local_day(df: DataFrame, ts: str, day: str) -> DataFrame:
    """Rows of a day at +09:00, as a range of the column so that it reaches the scan."""
    low = F.to_timestamp_ntz(F.lit(day)) - F.expr("INTERVAL 9 HOURS")
    return df.filter((F.col(ts) >= low) & (F.col(ts) < low + F.expr("INTERVAL 1 DAY")))


def valid_tokens(df: DataFrame, now: Column) -> DataFrame:
    return df.filter((F.col("used") == 0) & (F.col("expires_at") > now))


def valid_email(col: Column) -> Column:
    """Canonical form of an address, null if it is none."""
    c = F.lower(F.trim(col))
    return F.when(c.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"), c)


def filter_users(df: DataFrame, q: str = "", plan: str = "", user_type: str = "") -> DataFrame:
    hit = F.lower("display_name").contains(q.lower()) | F.lower("email").contains(q.lower())
    df = df.filter(hit) if q else df
    for name, want, default in (("plan", plan, "free"), ("user_type", user_type, "general")):
        if want:
            df = df.filter(F.coalesce(name, F.lit(default)) == want)
    return df


def check_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """A row (key, rule) for each rule that a row breaks; a null is no violation."""
    broken = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())))
    return df.select(key, F.explode(broken).alias("rule"))


def public_view(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).orderBy(cols[0])


def apply_patch(df: DataFrame, patches: DataFrame, key: str, allowed: list[str], skip_null: bool) -> DataFrame:
    """Sets the allowed columns that a patch names in its array `present`; with `skip_null` nulls change nothing."""
    p = patches.select(F.col(key).alias("_key"), "present", *(F.col(c).alias(f"_{c}") for c in allowed if c in patches.columns))
    out = df.join(p, df[key] == p["_key"], "left")
    for c in (c for c in allowed if c in patches.columns):
        named = F.coalesce(F.array_contains("present", c), F.lit(False))
        out = out.withColumn(c, F.when(named & (F.col(f"_{c}").isNotNull() | F.lit(not skip_null)), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(*df.columns)


def drop_noise_lines(df: DataFrame, line: str, min_len: int, skip: list[str]) -> DataFrame:
    keep = (F.length(line) >= min_len) & ~F.col(line).rlike(r"^\d+$")
    for w in skip:
        keep &= ~F.contains(line, F.lit(w))
    return df.filter(keep)


def allowed_source(url: Column, hosts: list[str], extensions: list[str]) -> Column:
    host = "|".join(h.replace(".", r"\.") for h in hosts)
    ext = "|".join(x.lstrip(".") for x in extensions)
    return url.rlike(rf"^https?://([a-z0-9.-]+\.)?({host})(/|$)") | F.lower(url).rlike(rf"\.({ext})$")


def level_tier(level: Column) -> Column:
    tier = F.when(level == 0, "owner")
    for top, name in ((9, "admin"), (49, "manager"), (99, "staff"), (199, "member"), (254, "guest")):
        tier = tier.when(level <= top, name)
    return tier.otherwise("new")


# joins


def with_name(df: DataFrame, dim: DataFrame, fk: str, pk: str, name: str, out: str) -> DataFrame:
    d = dim.select(F.col(pk).alias("_pk"), F.col(name).alias(out))
    return df.join(d, df[fk] == d["_pk"], "left").drop("_pk")


def folder_members(members: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("user_id"), "display_name")
    return members.join(u, "user_id").orderBy("permission", "folder_id", "user_id")


def pending_reviews(reviews: DataFrame, voices: DataFrame, users: DataFrame, folders: DataFrame) -> DataFrame:
    df = reviews.filter("status = 'pending'")
    df = df.join(voices.select(F.col("id").alias("voice_id"), F.col("name").alias("voice_name")), "voice_id")
    df = df.join(users.select(F.col("id").alias("requested_by"), F.col("display_name").alias("requester")), "requested_by")
    return df.join(folders.select(F.col("id").alias("shared_folder_id"), F.col("name").alias("folder_name")), "shared_folder_id", "left")


def folder_counts(folders: DataFrame, voices: DataFrame) -> DataFrame:
    """Shared voices of each folder, 0 for none."""
    n = voices.filter("folder_type = 'shared'").groupBy(F.col("shared_folder_id").alias("id")).agg(F.count("*").alias("voice_count"))
    return folders.join(n, "id", "left").withColumn("voice_count", F.coalesce("voice_count", F.lit(0)))


def accessible_folders(folders: DataFrame, members: DataFrame, users: DataFrame, voices: DataFrame, viewer: int, is_admin: bool) -> DataFrame:
    df = folder_counts(with_name(folders, users, "owner_id", "id", "display_name", "owner_name"), voices)
    if is_admin:
        return df
    mine = members.filter(F.col("user_id") == viewer).select(F.col("folder_id").alias("id"), "permission")
    return df.join(mine, "id")


def mentions(pages: DataFrame, cards: DataFrame, strip: str = ",.", widest: int = 64) -> DataFrame:
    """(page_id, card_id) where a card's text occurs in a page's, without the characters of `strip`; empty cards never do.

    A page is cut once into consecutive pieces of s characters. A card of 2 s - 1 or more holds one of them whole wherever it
    lies, so its pieces of s at the offsets 0 to s - 1 are looked up among the page's, by hash. Cards use the largest power of two
    for s up to `widest`; a page is cut for each s that some card uses (seven at most). Only hashes and ids are joined; the
    texts meet once for each pair that shares a piece, to test it.
    """
    p = pages.select("page_id", F.translate("text", strip, "").alias("_t"))
    c = cards.select("card_id", F.translate("text", strip, "").alias("_c")).filter("_c <> ''")
    c = c.withColumn("_s", F.least(F.lit(widest), F.pow(F.lit(2), F.floor(F.log2((F.length("_c") + 1) / 2)))).cast("int"))
    sizes = sorted(r["_s"] for r in c.select("_s").distinct().collect())
    offsets = F.transform(F.sequence(F.lit(1), F.col("_s")), lambda i: F.xxhash64(F.col("_s"), F.substring("_c", i, F.col("_s"))))
    of_cards = c.select("card_id", F.explode(F.array_distinct(offsets)).alias("_h"))
    cut = lambda s: F.transform(F.regexp_extract_all("_t", F.lit(f"(?s).{{{s}}}"), F.lit(0)), lambda x: F.xxhash64(F.lit(s), x))
    pieces = F.concat(*map(cut, sizes)) if sizes else F.array().cast("array<bigint>")
    of_pages = p.select("page_id", F.explode(F.array_distinct(pieces)).alias("_h"))
    met = of_pages.join(of_cards, "_h").select("page_id", "card_id").distinct()
    return met.join(c, "card_id").join(p, "page_id").filter(F.contains("_t", "_c")).select("page_id", "card_id").distinct()


#: Levels of aligned page ranges: a range of 2 ** 40 pages is the widest.
LEVELS = 40


def pages_in_sections(pages: DataFrame, sections: DataFrame, last: DataFrame) -> DataFrame:
    """Pages with the sections of their file that hold them, and the index of the page in its section.

    A section of any width is cut into aligned ranges of 2 ** level pages, two a level at most, so they are as many as its width
    has bits. A page looks up the range that holds it on each level that its file uses, and meets only sections that hold it. A row
    without a file or page is in no section.
    """
    s = sections.join(last, "pdf").withColumn("stop", F.least("end_page", "last_page")).filter("start_page <= stop")
    first = lambda i: F.ceil(F.col("start_page") / F.pow(F.lit(2.0), i)).cast("long")
    end = lambda i: F.floor((F.col("stop") + 1) / F.pow(F.lit(2.0), i)).cast("long")
    some = lambda i, n, odd: F.when((first(i) < end(i)) & (odd % 2 != 0), F.struct(i.cast("int").alias("level"), n.alias("node")))
    nodes = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda i: F.array(some(i, first(i), first(i)), some(i, end(i) - 1, end(i)))))
    s = s.withColumn("_node", F.explode(F.array_compact(nodes)))
    levels = s.groupBy("pdf").agg(F.collect_set("_node.level").alias("_levels"))
    at = F.transform("_levels", lambda i: F.struct(i.alias("level"), F.floor(F.col("page") / F.pow(F.lit(2.0), i)).cast("long").alias("node")))
    df = pages.join(levels, "pdf").withColumn("_node", F.explode(at)).drop("_levels").join(s, ["pdf", "_node"])
    return df.withColumn("page_index", F.col("page") - F.col("start_page")).drop("stop", "last_page", "_node")


def section_lines(lines: DataFrame, sections: DataFrame, least: int = 3, skip: tuple = ()) -> DataFrame:
    """The lines of each section's pages in its file (pdf, page, line_no, line), trimmed, without noise, with the section's columns and `page_count`."""
    pages = lines.select("pdf", "page").distinct()
    last = pages.groupBy("pdf").agg(F.max("page").alias("last_page"))
    held = pages_in_sections(pages, sections, last).withColumn("page_count", F.col("end_page") - F.col("start_page") + 1)
    clean = drop_noise_lines(lines.withColumn("line", F.trim("line")), "line", least, list(skip))
    return clean.join(held, ["pdf", "page"])


def gloss(df: DataFrame, col: str, dictionary: DataFrame, script: str = HAN, bound: int = BOUND) -> DataFrame:
    """Adds `gloss`: that of the whole cleaned text in a dictionary (term, gloss), else those of its longest known pieces.

    Pieces are looked for in texts of two characters or more of the script. Without either the gloss is null.
    """
    clean = F.regexp_replace(col, r"[，。！？、；：\s,.!?]", "")
    df = df.withColumn("_clean", clean)
    terms = dictionary.filter("gloss <> ''").groupBy("term").agg(F.min("gloss").alias("_whole"))
    df = df.join(terms, df["_clean"] == terms["term"], "left").drop("term")
    df = segmented(df, "_clean", dictionary, "_pieces", bound=bound)
    pieces = F.when((F.length("_clean") >= 2) & has_script(F.col("_clean"), script), F.col("_pieces"))
    return df.withColumn("gloss", F.coalesce("_whole", pieces)).drop("_clean", "_whole", "_pieces")


def cascade_delete(parent: DataFrame, children: list[tuple[DataFrame, str]], keys: DataFrame, key: str) -> list[DataFrame]:
    """The parent and each (child, foreign key) without what hangs on the keys."""
    out = [parent.join(keys.select(key), key, "left_anti")]
    return out + [c.join(keys.select(F.col(key).alias(fk)), fk, "left_anti") for c, fk in children]


def effective_permission(users: DataFrame, folders: DataFrame, members: DataFrame) -> DataFrame:
    """user, folder, permission (admin up to level 10, else that of the membership) where there is any, and its gates."""
    admins = users.filter("level <= 10").select(F.col("id").alias("user_id"))
    admin = every_pair(admins, folders.select(F.col("id").alias("folder_id"))).withColumn("permission", F.lit("admin"))
    plain = members.join(admins, "user_id", "left_anti").select("user_id", "folder_id", "permission")
    df = admin.select("user_id", "folder_id", "permission").unionByName(plain)
    return df.withColumns({"can_edit": F.col("permission").isin("edit", "admin"), "can_admin": F.col("permission") == "admin"})


def permission_rules(users: DataFrame, members: DataFrame) -> DataFrame:
    """The same without a row for each folder of those who may do all: they have one row without a folder, flagged `sees_all`."""
    admins = users.filter("level <= 10").select(F.col("id").alias("user_id"))
    plain = members.join(admins, "user_id", "left_anti").select("user_id", "folder_id", "permission", F.lit(False).alias("sees_all"))
    kind = members.schema["folder_id"].dataType
    df = plain.unionByName(admins.select("user_id", F.lit(None).cast(kind).alias("folder_id"), F.lit("admin").alias("permission"), F.lit(True).alias("sees_all")))
    return df.withColumns({"can_edit": F.col("permission").isin("edit", "admin"), "can_admin": F.col("permission") == "admin"})


# aggregates


def study_stats(records: DataFrame, now: str, cards: DataFrame | None = None, owner: str = "user_id", shared: tuple = SHARED) -> DataFrame:
    """Attempts of each user in one pass: count, mean of positive scores (0 if none), starred, and today's.

    With `cards` also `total_cards`, those a user sees (the own ones and all shared ones), and users that only have cards.
    """
    today = local_day(F.col("created_at")) == local_day(F.to_timestamp_ntz(F.lit(now)))
    got = records.groupBy("user_id").agg(
        F.count("*").alias("attempts"),
        F.round(F.coalesce(F.avg(F.when(F.col("score") > 0, F.col("score"))), F.lit(0.0)), 1).alias("avg_score"),
        F.count_if("is_starred").alias("starred"),
        F.count_if(today).alias("today"),
    )
    return got if cards is None else _with_total_cards(got, cards, owner, shared)


def _with_total_cards(got: DataFrame, cards: DataFrame, owner: str = "user_id", shared: tuple = SHARED) -> DataFrame:
    is_shared = F.coalesce(F.col("category").isin(*shared), F.lit(False))
    own = cards.filter(~is_shared & F.col(owner).isNotNull()).groupBy(F.col(owner).alias("user_id")).agg(F.count("*").alias("_own"))
    every = cards.agg(F.count_if(is_shared).alias("_shared"))  # one row
    df = got.join(own, "user_id", "full").join(F.broadcast(every), F.lit(True))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("attempts", "avg_score", "starred", "today")}
    return df.withColumns(zero | {"total_cards": F.coalesce("_own", F.lit(0)) + F.col("_shared")}).drop("_own", "_shared")


def subject_counts(cards: DataFrame) -> DataFrame:
    return cards.filter("subject <> ''").groupBy("subject", "week", "class_num").agg(F.count("*").alias("n"))


def card_progress(cards: DataFrame, records: DataFrame, per_user: bool = False) -> DataFrame:
    """Best score, attempts and attempts of 100 or more of each card; records are summed before the join."""
    keys = ["card_id", "user_id"] if per_user else ["card_id"]
    got = records.groupBy(*keys).agg(F.max("score").alias("best"), F.count("*").alias("attempts"), F.count_if(F.col("score") >= 100).alias("perfect"))
    df = cards.join(got, cards["id"] == got["card_id"], "left").drop("card_id")
    return df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("attempts", "perfect")})


def daily_stats(records: DataFrame, days: int = 7) -> DataFrame:
    """The last `days` days on which a user was active."""
    df = records.groupBy("user_id", local_day(F.col("created_at")).alias("day"))
    df = df.agg(F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("avg_score"), F.max("score").alias("max_score"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))
    return df.withColumn("rn", rank).filter(F.col("rn") <= days).drop("rn")


def feedback_rollup(checkpoints: DataFrame, feedback: DataFrame) -> DataFrame:
    got = feedback.filter("checkpoint_id <> 0").groupBy(F.col("checkpoint_id").alias("id")).agg(F.avg("score").alias("avg_score"), F.count("*").alias("n"))
    return checkpoints.join(got, "id", "left").withColumns({"avg_score": F.coalesce("avg_score", F.lit(0.0)), "n": F.coalesce("n", F.lit(0))})


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def user_stats(users: DataFrame, paid: tuple = ("basic", "pro", "max")) -> DataFrame:
    plan = F.coalesce("plan", F.lit("free"))
    return users.agg(F.count("*").alias("total"), F.count_if(F.col("level") <= 10).alias("admins"), F.count_if(F.col("user_type") == "beta").alias("beta"), F.count_if(plan.isin(*paid)).alias("paid"), F.count_if(F.col("user_type") == "voice").alias("voice"))


def training_eligibility(chosen: DataFrame, voices: DataFrame) -> DataFrame:
    """For each group of chosen voices (group_id, pos, voice_id): seconds of those that exist, verdict, and the first one's name."""
    df = chosen.join(voices, "voice_id").groupBy("group_id").agg(F.sum("duration").alias("seconds"), F.min_by("name", "pos").alias("name"))
    return df.withColumn("verdict", F.when(F.col("seconds") < 30, "reject").when(F.col("seconds") < 120, "warn").otherwise("ok"))


def chosen_voices(df: DataFrame, group: str, ids: str) -> DataFrame:
    """group_id, pos and voice_id of lists of ids such as "3, 5,,7"; empty parts are left out, and so are parts that are no number."""
    parts = df.select(F.col(group).alias("group_id"), F.posexplode(F.split(ids, ",")).alias("pos", "part"))
    return parts.select("group_id", "pos", F.trim("part").try_cast("long").alias("voice_id")).filter("voice_id is not null")


def import_summary(cards: DataFrame) -> DataFrame:
    return cards.groupBy(F.concat_ws(" ", "subject", "week", "class_num").alias("key")).agg(F.count("*").alias("n"))


def page_info(df: DataFrame, per: int) -> DataFrame:
    return df.agg(F.count("*").alias("total")).withColumn("total_pages", F.greatest(F.lit(1), F.ceil(F.col("total") / per)).cast("long"))


def best_attempt(df: DataFrame, keys: list[str]) -> DataFrame:
    """The first of the best tries of each key, and the number of tries."""
    return df.groupBy(*keys).agg(F.max(F.struct("score", (-F.col("index")).alias("n"))).alias("b"), F.count("*").alias("tries")).select(*keys, (-F.col("b.n")).alias("index"), "b.score", "tries")


def work_progress(df: DataFrame, keys: list[str], done: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(done).alias("done"))


def latest_per(df: DataFrame, key: str, ts: str, n: int, tie: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie)))
    return df.withColumn("rn", rank).filter(F.col("rn") <= n)


def recent_attempts(records: DataFrame, cards: DataFrame, n: int) -> DataFrame:
    """A user's latest attempts with the card's text; the n latest are picked before the join."""
    df = latest_per(records, "user_id", "created_at", n, "id")
    return df.join(cards.select(F.col("id").alias("card_id"), "chinese", "subject"), "card_id", "left")


def dashboard(records: DataFrame, cards: DataFrame, now: str, days: int = 7, n: int = 20, salts: int = 64) -> DataFrame:
    """One row a user: statistics (with the visible cards, if cards have owners), and arrays of its last days and attempts (both bounded).

    Records are scanned once and shuffled once: each salt of a user's day keeps its `n` latest, a day merges these, a user its days.
    A day has an attempt, so the `n` latest attempts lie in the `n` latest days. A user without a record has nulls for both arrays; a record without a time comes last.
    """
    attempt = F.struct("created_at", "id", "card_id", "score")
    df = records.select("user_id", "created_at", "id", "card_id", "score", "is_starred", local_day(F.col("created_at")).alias("day"), F.pmod(F.xxhash64("id"), F.lit(salts)).alias("_salt"))
    rank = F.row_number().over(Window.partitionBy("user_id", "day", "_salt").orderBy(F.desc("created_at"), F.desc("id")))
    latest = lambda c: F.slice(F.sort_array(c, False), 1, n)
    df = df.withColumn("_r", rank).groupBy("user_id", "day").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("avg_score"), F.max("score").alias("max_score"), F.count_if("is_starred").alias("starred"),
        F.count_if(F.col("score") > 0).alias("above"), F.sum(F.when(F.col("score") > 0, F.col("score"))).alias("points"),
        latest(F.collect_list(F.when(F.col("_r") <= n, attempt))).alias("latest"),
    )
    df = df.withColumn("_d", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day"))))
    today = F.col("day") == local_day(F.to_timestamp_ntz(F.lit(now)))
    df = df.groupBy("user_id").agg(
        F.sum("n").alias("attempts"), F.round(F.coalesce(F.sum("points") / F.when(F.sum("above") > 0, F.sum("above")), F.lit(0.0)), 1).alias("avg_score"),
        F.sum("starred").alias("starred"), F.coalesce(F.sum(F.when(today, F.col("n"))), F.lit(0)).alias("today"),
        F.sort_array(F.collect_list(F.when(F.col("_d") <= days, F.struct("day", "n", "avg_score", "max_score"))), False).alias("daily"),
        latest(F.flatten(F.collect_list(F.when(F.col("_d") <= n, F.col("latest"))))).alias("latest"),
    )
    texts = cards.select(F.col("id").alias("card_id"), "chinese")
    named = df.select("user_id", F.explode("latest").alias("a")).select("user_id", "a.*").join(texts, "card_id", "left")
    named = named.groupBy(F.col("user_id").alias("_user")).agg(F.sort_array(F.collect_list(F.struct("created_at", "id", "card_id", "chinese", "score")), False).alias("recent"))
    df = df.drop("latest").join(named, F.col("user_id").eqNullSafe(F.col("_user")), "left").drop("_user")
    return _with_total_cards(df, cards) if "user_id" in cards.columns else df
