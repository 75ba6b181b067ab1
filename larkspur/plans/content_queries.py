"""Queries over chats, texts, the catalogue, quizzes, imports, and new table states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import text
from larkspur.operators import audit, catalog, chats, ingest, mutations, quiz, reads, search, substrings
from larkspur.sources import tables as t
from larkspur.streaming.store import shared_path


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.chat_messages(spark, sf_dir)


def chat_sessions_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chats.sessions(_titled(spark, sf_dir))
    return made.select("session_id", "created", F.size("messages").cast("long").alias("n"), F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ",").alias("shape"))


def chat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.titles(_titled(spark, sf_dir))


def chat_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.search(_titled(spark, sf_dir), " THEre ")


def chat_history_shaping(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chats.model_history(chats.sessions(_titled(spark, sf_dir)))
    return made.select("session_id", F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ",").alias("history"))


def chat_merge_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    server = chats.titles(_titled(spark, sf_dir)).withColumn("origin", F.lit("server"))
    return mutations.merge_missing(server.where("session_id % 3 = 0").withColumn("origin", F.lit("local")), server, "session_id")


def text_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("  أحمد إسراء آلاء مدرسةً \n"), F.coalesce("text", F.lit(""))).alias("x"))
    return d.select("doc_id", text.collapse(F.col("x")).alias("collapsed"), text.shorten(text.collapse(F.col("x")), 38).alias("title"), text.fold_search(F.col("x")).alias("folded"), text.fold_reading(F.col("x")).alias("reading"), text.initial(F.col("x")).alias("initial"))


def name_and_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.lit("Sara  Ali")).when(F.col("c_custkey") % 3 == 1, F.lit("علي حسن")).otherwise(F.col("c_name")).alias("name"), F.concat(F.lit("05-"), (F.col("c_custkey") * 7919 % 90000000).cast("string")).alias("phone"))
    return c.select("id", text.collapse(F.col("name")).rlike(text.CLIENT_NAME).alias("client_ok"), F.trim("name").rlike(text.SERVER_NAME).alias("server_ok"), text.handle_base(F.col("name")).alias("handle"), text.phone(F.col("phone")).alias("phone"), text.phone_valid(F.col("phone")).alias("phone_ok"))


def user_agent_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    agents = (
        "Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120", "Mozilla/5.0 (iPhone; CPU iPhone OS 17 like Mac OS X) Safari/604", "Mozilla/5.0 (Macintosh; Intel Mac OS X) Firefox/120",
        "Mozilla/5.0 (Linux; Android 14) Chrome/120 Mobile Safari/537", "Opera/9.80 (X11; Linux)", "curl/8",
    )
    said = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, agents)), (F.col("doc_id") % 6 + 1).cast("int")), F.col("text"))
    ua = F.col("agent")
    return t.table(spark, sf_dir, "documents").select("doc_id", text.stored_agent(said).alias("agent")).select("doc_id", F.length(ua).alias("length"), text.operating_system(ua).alias("os"), text.browser(ua).alias("browser"), text.device_type(ua).alias("device"), text.device_label(ua).alias("label"), text.join_nonempty(text.device_type(ua), F.lit(""), text.browser(ua)).alias("joined"))


def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents like a pattern, by an index of the trigrams of all texts that is written to the shared folder."""
    docs = t.table(spark, sf_dir, "documents")
    path = shared_path(spark, "trigrams")
    substrings.write(substrings.postings(docs, "doc_id", F.col("text")), path)
    return substrings.like(docs, spark.read.parquet(path), "doc_id", F.col("text"), "%heath_%the%").select("doc_id", "lang")


def pdf_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files made of the documents' texts, two in three with the magic bytes of a PDF."""
    body = F.encode(F.concat(F.when(F.col("doc_id") % 3 != 0, "%PDF-1.7 ").otherwise("<html>"), F.coalesce("text", F.lit(""))), "UTF-8")
    files = t.table(spark, sf_dir, "documents").select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id")).alias("path"), body.alias("content"))
    return ingest.pdf_valid(files.withColumn("length", F.length("content").cast("long")))


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type"), F.concat("event_id", F.lit(".PDF")))
    return t.events(spark, sf_dir).select("event_id", text.path_part(p, 1).alias("folder"), text.path_part(p, -1).alias("base"), text.extension(p).alias("extension"), text.pdf_escape(F.concat(F.lit("(a\\b) "), p)).alias("escaped"), F.url_decode(F.lit("a%20b%2Fc")).alias("decoded"))


def rich_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("see ["), F.col("source"), F.lit("](/s/"), F.col("doc_id"), F.lit(") and [x](http://no) "), F.coalesce("text", F.lit("")), F.lit(" and ["), F.col("lang"), F.lit("](/l)"))
    found = t.table(spark, sf_dir, "documents").select("doc_id", F.explode(text.rich_links(said)).alias("link"))
    return found.select("doc_id", "link.label", "link.href")


def faq_style_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cat"), F.col("source").alias("q"), F.col("text").alias("a"))
    return search.find(items, " Heatha ", "en").select("id", "cat")


def faq_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five answers to a query, and the popular ones."""
    items = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("cat"), F.col("source").alias("q"), F.col("text").alias("a"), (F.col("source") == "src3").alias("popular"))
    found = search.find(items, "THE", k=5).select(F.lit("found").alias("list"), "id")
    return found.unionByName(search.popular(items).select(F.lit("popular").alias("list"), "id"))


def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, tags, mentions and spaces of every body, counted."""
    counted = t.bodies(spark, sf_dir).select("post_id", F.explode(text.tokens(F.col("content"))).alias("t"))
    return counted.groupBy("post_id").agg(*(F.count(F.when(F.col("t.kind") == kind, 1)).alias(f"n_{kind}") for kind in ("tag", "mention", "word")), F.sum(F.length("t.token")).alias("n_chars"))


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO strings as milliseconds; strings that are no times give none."""
    iso = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).when(F.col("event_id") % 2 == 0, "soon")
    return t.events(spark, sf_dir).select("event_id", text.epoch_ms(iso).alias("ms"))


def faq_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured data of each region's list of nations."""
    nations = t.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_name").alias("q"), F.col("n_nationkey").cast("string").alias("a")))).alias("items"))
    return nations.select("region", text.faq_json_ld(F.col("items")).alias("json"))


def _shelves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the subjects of a catalogue, one in three in both terms."""
    k = F.col("p_partkey")
    terms = F.when(k % 3 == 0, F.array(F.lit("t1"), F.lit("t2"))).when(k % 3 == 1, F.array(F.lit("t1"))).otherwise(F.array(F.lit("t2")))
    return t.table(spark, sf_dir, "part").select(_shelf(k).alias("path"), F.concat(F.lit("p"), k).alias("subject"), terms.alias("terms"))


def _shelf(part: Column) -> Column:
    return F.concat(F.lit("hall-"), part % 7, F.lit("/shelf-"), part % 50)


def _part_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, brand and name of each part as a path, and its size."""
    return t.table(spark, sf_dir, "part").select(F.concat_ws("/", F.lower("p_type"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("path"), "p_size")


def resource_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exams of the first term of all parts sold; those of the second term only have none."""
    part = F.col("l_partkey")
    asked = t.table(spark, sf_dir, "lineitem").select("l_partkey").distinct().select(F.concat(F.lit(f"{catalog.YEAR}/"), _shelf(part), F.lit("/p"), part, F.lit("/t1/exams.pdf")).alias("key"))
    return catalog.by_key(catalog.resources(_shelves(spark, sf_dir)), asked)


def kv_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user JSON values read as rows."""
    return t.events(spark, sf_dir).select("event_id", F.from_json("props", "k long")["k"].alias("k"), F.to_json(F.struct("event_type", "user_id")).alias("json"))


def catalog_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.resources(_shelves(spark, sf_dir))


def catalog_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.tree(_part_paths(spark, sf_dir))


def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counts(catalog.resources(_shelves(spark, sf_dir)))


def catalog_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trails of all parts' paths in a catalogue of the smaller parts; some aren't in it."""
    paths = _part_paths(spark, sf_dir)
    return catalog.trails(catalog.tree(paths.where("p_size <= 25")), paths)


def prefixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose place on the web starts with one of several prefixes."""
    key = F.regexp_replace("url", "^https?://", "")
    return t.table(spark, sf_dir, "pages").select("page_id", key.alias("key")).where(ingest.has_prefix(F.col("key"), ["m.", "blog.", "www.th"]))


def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members after all suppliers are added, who bring no experience."""
    new = t.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000_000).alias("id"), F.col("s_name").alias("username"))
    return mutations.insert(t.profiles(spark, sf_dir).select("id", "username", "xp"), new)


def single_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the one member of a name; a name that nobody has adds none."""
    members = t.profiles(spark, sf_dir)
    one, nobody = reads.single(reads.match(members, {"username": "Customer#000000007"})), reads.maybe_single(reads.match(members, {"username": "nobody"}))
    return reads.is_in(t.posts(spark, sf_dir), "user_id", [r["id"] for r in (one, nobody) if r]).select("id", "user_id", "created_at")


def region_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of nested places as one list of paths, with resources for each term."""
    regions, nations, suppliers = (t.table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    top = regions.select(F.col("r_regionkey").alias("rk"), F.col("r_name").alias("path"))
    middle = top.join(nations, F.col("rk") == F.col("n_regionkey")).select("n_nationkey", F.concat_ws("/", "path", "n_name").alias("path"))
    leaf = middle.join(suppliers, F.col("n_nationkey") == F.col("s_nationkey")).select(F.concat_ws("/", "path", "s_name").alias("path"))
    every = top.select("path").unionByName(middle.select("path")).unionByName(leaf)
    return every.select("path", F.explode(F.array(F.lit("t1"), F.lit("t2"))).alias("term"))


def quiz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = t.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("attempt"), F.col("l_linenumber").alias("question"), F.when(F.col("l_returnflag") != "N", F.col("l_quantity").cast("int") % 4).alias("choice"), (F.col("l_partkey") % 4).cast("int").alias("answer"))
    return quiz.score(quiz.grade(answers))


def quiz_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_brand", "p_type").alias("options"), (F.col("p_partkey") % 3).cast("int").alias("answer_index"))
    return quiz.draw(questions, 10, 3)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = t.profiles(spark, sf_dir).select("id", "username", "xp")
    changes = t.events(spark, sf_dir).select(F.col("user_id").alias("id"), F.when(F.col("event_type") != "error", F.col("value")).alias("xp"), "ts", "event_id")
    return mutations.upsert(state, changes, ["id"], [F.desc("ts"), F.desc("event_id")])


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = t.events(spark, sf_dir).where("user_id % 4 = 0 and event_type = 'signup'").groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    rows = t.events(spark, sf_dir).where("event_type = 'purchase'").select("user_id", "event_id")
    return mutations.insert_if_absent(state, rows, ["user_id"], [F.col("event_id")])


def idempotent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.events(spark, sf_dir).select((F.col("event_id") % 700).alias("event_id"), F.col("event_id").alias("received"), "event_type")
    seen = mutations.latest(rows.where("received < 500"), ["event_id"], [F.col("received")])
    return mutations.append_events(seen, rows.where("received >= 500"))


def update_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = t.posts(spark, sf_dir).select("id", "status", "weight", F.col("created_at").alias("updated_at"))
    return mutations.update_where(state, (F.col("status") == "O") & (F.col("weight") > 100000), {"status": F.lit("R")}, F.to_timestamp_ntz(F.lit("2024-02-01 00:00:00")))


def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = t.profiles(spark, sf_dir).select("id", F.when(F.col("id") % 5 != 0, F.col("xp")).alias("xp"))
    return mutations.delete_where(state, F.col("xp") < 0)


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of members, posts and reactions after the deletion of some members, by table."""
    acts = t.reactions(spark, sf_dir).select((F.col("post_id") * 10 + F.col("seq")).alias("id"), "post_id")
    left = mutations.delete_cascade({"profiles": t.profiles(spark, sf_dir).select("id", "xp"), "posts": t.posts(spark, sf_dir).select("id", "user_id"), "reactions": acts}, "profiles", F.col("xp") < 0, [("posts", "profiles", "user_id"), ("reactions", "posts", "post_id")])
    parts = [df.select(F.lit(name).alias("table"), "id") for name, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def set_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.set_null(t.posts(spark, sf_dir).select("id", "user_id"), t.profiles(spark, sf_dir).where("xp >= 0"), "user_id")


def reaction_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    toggles = t.events(spark, sf_dir).where("event_type in ('click', 'view')").select((F.col("event_id") % 12).alias("post_id"), "user_id", F.when(F.col("event_type") == "click", "like").otherwise("dislike").alias("kind"), F.col("event_id").alias("seq"))
    return mutations.reaction_state(toggles)


def keep_one_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = t.events(spark, sf_dir).select(F.concat_ws("/", F.col("user_id").cast("string"), F.concat("event_id", F.lit(".png"))).alias("path"))
    return mutations.keep_blob(paths, F.lit("7/"), F.lit("7/x.png"))


def import_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a made-up manifest against the catalogue."""
    rows = t.events(spark, sf_dir).select(
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("k/"), F.col("user_id"), F.lit(".pdf"))).when(F.col("event_id") % 4 == 1, F.lit("../x.pdf")).otherwise(F.concat(F.lit("z/"), F.col("event_id"), F.lit(".pdf"))).alias("key"),
        F.when(F.col("event_id") % 3 == 0, "https://files.example.org/a.pdf").otherwise("http://example.org/b.pdf").alias("url"),
    )
    known = t.events(spark, sf_dir).select(F.concat(F.lit("k/"), F.col("user_id"), F.lit(".pdf")).alias("key"))
    return ingest.report(ingest.status(rows, known, known.where("key < 'k/2'"), ["example.org"]))


def media_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t.events(spark, sf_dir)
    mime = F.element_at(F.array(F.lit("image/png"), F.lit("video/mp4"), F.lit("text/html")), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select("event_id", ingest.media_valid(mime, (F.col("event_id") * 65536 % (80 << 20)), F.col("event_id") % 60).alias("ok"), ingest.avatar_valid(mime, F.col("event_id") * 65536 % (80 << 20)).alias("as_avatar"))


def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = t.events(spark, sf_dir).select(F.concat_ws("/", "event_type", F.col("event_id").cast("string")).alias("path"))
    return ingest.listed(paths, "signup/1")


def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"rating_range": (F.col("value") / 25).between(1, 5), "not_self": F.col("user_id") != F.col("event_id"), "one_target": audit.exactly_one(F.when(F.col("event_id") % 2 == 0, 1), F.when(F.col("event_id") % 3 != 0, 1))}
    found = audit.violations(t.events(spark, sf_dir), checks)
    twice = audit.duplicates(t.events(spark, sf_dir), ["user_id", "event_type"]).agg(F.count("*").alias("n")).select(F.lit("unique_pair").alias("check"), "n")
    lost = audit.orphans(t.posts(spark, sf_dir), "user_id", t.profiles(spark, sf_dir).where("xp > 0")).agg(F.count("*").alias("n")).select(F.lit("orphans").alias("check"), "n")
    return found.unionByName(twice).unionByName(lost)


QUERIES = {name: f for name, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not name.startswith("_")}

_ROLE = "case when role = 'assistant' then 'assistant' else 'user' end"
_FIRST = "u as (select conv_id, arg_min(text, turn) as content from conversations where role <> 'assistant' group by 1)"
_TITLE = r"""tt as (select c.conv_id as session_id, case when u.conv_id is null then 'محادثة جديدة' else x end as title from (select distinct conv_id from conversations) c left join
 (select conv_id, case when length(w) > 38 then substr(w, 1, 38) || '…' else w end as x from (select conv_id, trim(regexp_replace(content, '\s+', ' ', 'g')) as w from u)) u using (conv_id))"""
_X = r"select doc_id, '  أحمد إسراء آلاء مدرسةً ' || chr(10) || coalesce(text, '') as x from documents"
_SP = r"[\s\x0b\x85\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_C = rf"trim(regexp_replace(x, '{_SP}+', ' ', 'g'))"

#: A catalogue of parts as SQL: subjects by shelf, and a resource for each subject, term in which it runs and kind of document.
_SHELVES = """with sub as (select 'hall-' || p_partkey % 7 || '/shelf-' || p_partkey % 50 as path, 'p' || p_partkey as subject, p_partkey % 3 as k from part),
res as (select path, subject, subject || '-' || term || '-' || suffix as id, title, d.kind, "order", term, term_name, '1447/' || path || '/' || subject || '/' || term || '/' || file as key
 from sub, (values ('t1', 'الفصل الدراسي الأول'), ('t2', 'الفصل الدراسي الثاني')) as t(term, term_name),
 (values (0, 'student', 'كتاب الطالب', 'textbook', 'student-book.pdf'), (1, 'activity', 'كتاب النشاط', 'workbook', 'activity-book.pdf'), (2, 'exams', 'نماذج اختبارات', 'exam', 'exams.pdf')) as d("order", suffix, title, kind, file)
 where k = 0 or (k = 1) = (term = 't1'))"""
_PATHS = "leaf as (select distinct lower(p_type) || '/' || replace(lower(p_brand), '#', '-') || '/' || replace(p_name, ' ', '-') as path, p_size <= 25 as small from part)"


def _nodes(where: str) -> str:
    """Every node of the tree of the leaves: all their prefixes."""
    return f"""parts as (select string_split(path, '/') as p, unnest(range(1, len(string_split(path, '/')) + 1))::int as depth from leaf where {where}),
nodes as (select array_to_string(p[:depth], '/') as path, case when depth > 1 then array_to_string(p[:depth - 1], '/') end as parent, depth, bool_or(depth = len(p)) as is_leaf from parts group by all)"""


_AGENTS = """a as (select doc_id, substr(v || coalesce(' ' || text, ''), 1, 400) as ua from documents join (values (0, 'Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120'), (1, 'Mozilla/5.0 (iPhone; CPU iPhone OS 17 like Mac OS X) Safari/604'),
 (2, 'Mozilla/5.0 (Macintosh; Intel Mac OS X) Firefox/120'), (3, 'Mozilla/5.0 (Linux; Android 14) Chrome/120 Mobile Safari/537'), (4, 'Opera/9.80 (X11; Linux)'), (5, 'curl/8')) as u(k, v) on k = doc_id % 6),
l as (select doc_id, length(ua) as length, lower(ua) as ua from a),
o as (select doc_id, length, case when contains(ua, 'windows') then 'Windows' when regexp_matches(ua, 'iphone|ipad|ipod') then 'iOS' when regexp_matches(ua, 'mac os x|macintosh') then 'macOS' when contains(ua, 'android') then 'Android' when contains(ua, 'linux') then 'Linux' else 'نظام غير معروف' end as o,
 case when contains(ua, 'edg/') then 'Edge' when regexp_matches(ua, 'opr/|opera') then 'Opera' when contains(ua, 'chrome/') then 'Chrome' when contains(ua, 'firefox/') then 'Firefox' when contains(ua, 'safari/') and not regexp_matches(ua, 'chrome|crios|android') then 'Safari' else 'متصفح' end as b,
 case when regexp_matches(ua, 'ipad|tablet') then 'جهاز لوحي' when regexp_matches(ua, 'mobile|iphone|android') then 'جوال' else 'حاسوب' end as d from l)"""

ORACLE_SQL = {
    "indexed_search": "select doc_id, lang from documents where text ilike '%heath_%the%'",
    "pdf_checks": """select source || '/' || doc_id as path, l as length, l between 1024 and 104857600 and doc_id % 3 <> 0 as ok from
 (select source, doc_id, octet_length(encode(case when doc_id % 3 <> 0 then '%PDF-1.7 ' else '<html>' end || coalesce(text, ''))) as l from documents)""",
    "chat_sessions_grouped": f"select conv_id as session_id, min(turn) as created, count(*) as n, string_agg({_ROLE} || ':' || length(text), ',' order by turn) as shape from conversations group by 1",
    "chat_titles": f"with {_FIRST}, {_TITLE} select * from tt",
    "chat_search": f"with {_FIRST}, {_TITLE} select * from tt where contains(lower(title), 'there') or session_id in (select conv_id from conversations where contains(lower(text), 'there'))",
    "chat_history_shaping": f"""with b as (select conv_id, turn, {_ROLE} as role, text, row_number() over (partition by conv_id order by turn desc) as back from conversations),
k as (select *, max(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as started from b where back > 1)
select c.conv_id as session_id, coalesce(string_agg(case role when 'assistant' then 'model' else 'user' end || ':' || length(text), ',' order by turn) filter (started = 1), '') as history
from (select distinct conv_id from conversations) c left join k using (conv_id) group by 1""",
    "chat_merge_local": f"with {_FIRST}, {_TITLE} select session_id, title, case when session_id % 3 = 0 then 'local' else 'server' end as origin from tt",
    "text_normalised": rf"""select doc_id, {_C} as collapsed, case when length({_C}) > 38 then substr({_C}, 1, 38) || '…' else {_C} end as title,
 regexp_replace(translate(lower(x), 'أإآة', 'اااه'), '^{_SP}+|{_SP}+$', '', 'g') as folded, regexp_replace(translate(regexp_replace(x, '[\x{{064B}}-\x{{0652}}\x{{0670}}]', '', 'g'), 'أإآ', 'ااا'), '{_SP}+', '', 'g') as reading, substr({_C}, 1, 1) as initial from ({_X})""",
    "name_and_phone": r"""with c as (select c_custkey as id, case c_custkey % 3 when 0 then 'Sara  Ali' when 1 then 'علي حسن' else c_name end as name, '05-' || (c_custkey * 7919 % 90000000) as p from customer)
select id, regexp_full_match(regexp_replace(name, '\s+', ' ', 'g'), '[A-Za-z\x{0600}-\x{06FF}]+\s+[A-Za-z\x{0600}-\x{06FF}]+') as client_ok, regexp_full_match(name, '[A-Za-z\x{0600}-\x{06FF}]+ +[A-Za-z\x{0600}-\x{06FF}]+') as server_ok,
 substr(regexp_replace(regexp_replace(lower(name), '\s+', '_', 'g'), '[^a-z0-9_\x{0600}-\x{06FF}]', '', 'g'), 1, 16) as handle, '+966' || regexp_replace(p, '\D', '', 'g') as phone, length(regexp_replace(p, '\D', '', 'g')) = 9 as phone_ok from c""",
    "user_agent_parse": f"with {_AGENTS} select doc_id, length, o as os, b as browser, d as device, o || ' — ' || b as label, d || ', ' || b as joined from o",
    "path_parts": r"""select event_id, user_id::varchar as folder, event_id || '.PDF' as base, 'pdf' as extension, '\(a\\b\) ' || user_id || '/' || event_type || '/' || event_id || '.PDF' as escaped, 'a b/c' as decoded from events""",
    "rich_links": r"""with d as (select doc_id, 'see [' || source || '](/s/' || doc_id || ') and [x](http://no) ' || coalesce(text, '') || ' and [' || lang || '](/l)' as x from documents)
select doc_id, unnest(regexp_extract_all(x, '\[([^\]]+)\]\((/[^)\s]*)\)', 1)) as label, unnest(regexp_extract_all(x, '\[([^\]]+)\]\((/[^)\s]*)\)', 2)) as href from d""",
    "faq_style_search": "select doc_id as id, lang as cat from documents where lang = 'en' and (contains(lower(text), 'heatha'))",
    "kv_documents": """select event_id, json_extract_string(props, '$.k')::bigint as k, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' as json from events""",
    "region_tree": """with p as (select r_name as path from region union all select r_name || '/' || n_name from region join nation on n_regionkey = r_regionkey
 union all select r_name || '/' || n_name || '/' || s_name from region join nation on n_regionkey = r_regionkey join supplier on s_nationkey = n_nationkey) select path, term from p, (values ('t1'), ('t2')) as t(term)""",
    "quiz_score": """select attempt, count(*) filter (c = a) as correct, count(*) as total, count(*) filter (c = a) * 10 as xp, floor(count(*) filter (c = a)::double / count(*) * 100 + 0.5)::bigint as percent
from (select l_orderkey as attempt, case when l_returnflag <> 'N' then l_quantity::int % 4 end as c, l_partkey % 4 as a from lineitem) group by 1""",
    "upsert_latest": """with l as (select user_id, arg_max({'v': case when event_type <> 'error' then value end}, (ts, event_id)) as s from events group by 1)
select coalesce(c_custkey, user_id) as id, c_name as username, case when user_id is not null then s.v else c_acctbal end as xp from customer full join l on c_custkey = user_id""",
    "insert_if_absent": """with s as (select user_id, min(event_id) as event_id from events where user_id % 4 = 0 and event_type = 'signup' group by 1)
select * from s union all select user_id, min(event_id) from events where event_type = 'purchase' and user_id not in (select user_id from s) group by 1""",
    "idempotent_events": "select event_id % 700 as event_id, min(event_id) as received, arg_min(event_type, event_id) as event_type from events group by 1",
    "update_where": "select o_orderkey as id, case when h then 'R' else o_orderstatus end as status, o_totalprice as weight, case when h then timestamp '2024-02-01' else o_orderdate end as updated_at from (select *, o_orderstatus = 'O' and o_totalprice > 100000 as h from orders)",
    "delete_where": "select c_custkey as id, case when c_custkey % 5 <> 0 then c_acctbal end as xp from customer where c_custkey % 5 = 0 or c_acctbal >= 0",
    "cascade_delete": """with p as (select c_custkey as id from customer where c_acctbal >= 0), o as (select o_orderkey as id from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0))
select 'profiles' as "table", id from p union all select 'posts', id from o union all select 'reactions', l_orderkey * 10 + l_linenumber from lineitem where l_orderkey in (select id from o) or l_orderkey not in (select o_orderkey from orders)""",
    "set_null": "select o_orderkey as id, c_custkey as user_id from orders left join customer on c_custkey = o_custkey and c_acctbal >= 0",
    "reaction_state": """with recursive e as (select event_id % 12 as post_id, user_id, case event_type when 'click' then 'like' else 'dislike' end as kind, row_number() over (partition by event_id % 12, user_id order by event_id) as i from events where event_type in ('click', 'view')),
s(post_id, user_id, i, state) as (select post_id, user_id, i, kind from e where i = 1 union all select e.post_id, e.user_id, e.i, case when s.state = e.kind then null else e.kind end from s join e on e.post_id = s.post_id and e.user_id = s.user_id and e.i = s.i + 1)
select post_id, user_id, arg_max(coalesce(state, 'none'), i) as kind from s group by 1, 2 having kind <> 'none'""",
    "keep_one_blob": "select user_id || '/' || event_id || '.png' as path from events where user_id <> 7",
    "import_statuses": """with r as (select case event_id % 4 when 0 then 'k/' || user_id || '.pdf' when 1 then '../x.pdf' else 'z/' || event_id || '.pdf' end as key, event_id % 3 = 0 as ok from events)
select case when key like '..%' then 'bad_key' when key like 'z/%' then 'unknown_key' when not ok then 'host_not_allowed' when key < 'k/2' then 'skipped' else 'fetch' end as status, count(*) as n from r group by 1""",
    "media_validation": """select event_id, case event_id % 3 when 0 then s <= 5242880 when 1 then s <= 52428800 and event_id % 60 <= 30 else false end as ok, event_id % 3 = 0 and s <= 2097152 as as_avatar from (select event_id, event_id * 65536 % 83886080 as s from events)""",
    "object_listing": "select event_type || '/' || event_id as path from events where event_type = 'signup' and event_id::varchar like '1%'",
    "constraint_audit": """select 'rating_range' as "check", count(*) filter (not (value / 25 between 1 and 5)) as n from events union all select 'not_self', count(*) filter (user_id = event_id) from events
union all select 'one_target', count(*) filter ((event_id % 2 = 0) = (event_id % 3 <> 0)) from events union all select 'unique_pair', count(*) from (select 1 from events group by user_id, event_type having count(*) > 1)
union all select 'orphans', count(*) from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)""",
    "faq_top": """(select 'found' as list, doc_id as id from documents where contains(lower(source), 'the') or contains(lower(text), 'the') order by doc_id limit 5)
union all (select 'popular', doc_id from documents where source = 'src3' order by doc_id limit 5)""",
    "text_tokens": rf"""with b as (select doc_id as post_id, '#' || source || ' #Lang_' || lang || ' @User' || (doc_id % 9) || ' ' || coalesce(text, '') as content from documents),
w as (select post_id, unnest(regexp_extract_all(content, '{_SP}+|[^\s]+')) as t from b)
select post_id, count(*) filter (regexp_full_match(t, '#[0-9A-Za-z_\x{{0600}}-\x{{06FF}}]{{2,50}}')) as n_tag, count(*) filter (regexp_full_match(t, '@[0-9A-Za-z_]{{2,30}}')) as n_mention,
 count(*) filter (not regexp_full_match(t, '{_SP}+|#[0-9A-Za-z_\x{{0600}}-\x{{06FF}}]{{2,50}}|@[0-9A-Za-z_]{{2,30}}')) as n_word, sum(length(t))::bigint as n_chars from w group by 1""",
    "iso_times": "select event_id, case when event_id % 5 <> 0 then epoch_us(ts) // 1000 end as ms from events",
    "faq_json_ld": """select n_regionkey as region, '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[' || string_agg('{"@type":"Question","name":"' || n_name || '","acceptedAnswer":{"@type":"Answer","text":"' || n_nationkey || '"}}', ',' order by n_name) || ']}' as json from nation group by 1""",
    "catalog_paths": f"with {_PATHS}, {_nodes('true')} select path, parent, depth, is_leaf from nodes",
    "catalog_trail": f"with {_PATHS}, {_nodes('small')} select leaf.path as asked, nodes.path, parent, depth, is_leaf from (select path from leaf where small group by 1) leaf join nodes on starts_with(leaf.path || '/', nodes.path || '/')",
    "catalog_resources": f"{_SHELVES} select path, subject, id, title, kind, \"order\", term, term_name, key from res",
    "catalog_counts": f"{_SHELVES} select path, subject, term, count(*) as resources from res group by all",
    "resource_by_key": f"{_SHELVES} select key, path, id, title, subject from res where ends_with(key, '/t1/exams.pdf') and subject in (select 'p' || l_partkey from lineitem)",
    "prefixed_keys": "select page_id, key from (select page_id, regexp_replace(url, '^https?://', '') as key from pages) where starts_with(key, 'm.') or starts_with(key, 'blog.') or starts_with(key, 'www.th')",
    "inserted_rows": "select c_custkey as id, c_name as username, c_acctbal as xp from customer union all select s_suppkey + 1000000000000, s_name, null from supplier",
    "single_member": "select o_orderkey as id, o_custkey as user_id, o_orderdate as created_at from orders join customer on c_custkey = o_custkey where c_name = 'Customer#000000007'",
    "quiz_shuffle": """with p as (select p_partkey as id, [p_name, p_brand, p_type] as o, (p_partkey % 3)::int as a from part order by md5('3:' || p_partkey), p_partkey limit 10),
x as (select id, a, unnest([0, 1, 2]) as i, unnest(o) as opt from p), y as (select *, (row_number() over (partition by id order by md5('3:' || id || ':' || i)) - 1)::int as place from x)
select id, list(opt order by place) as options, max(place) filter (i = a) as answer_index from y group by id""",
}
