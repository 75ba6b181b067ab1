"""Catalogues: a tree of paths whose leaves have subjects, terms and documents.

Trees and resources come from any table of leaves (``tree``) or of subjects
(``resources``) by explodes and joins on paths.  The curriculum is one such
table, small reference data built from rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.joins import join_wide

# Identifiers of the published curriculum.
YEAR = "1447"
TERMS = (("t1", "الفصل الدراسي الأول"), ("t2", "الفصل الدراسي الثاني"))
DOCUMENTS = (("student", "كتاب الطالب", "textbook", "student-book.pdf"), ("activity", "كتاب النشاط", "workbook", "activity-book.pdf"), ("exams", "نماذج اختبارات", "exam", "exams.pdf"))
SUBJECTS = {
    "elementary": ("quran", "islamic", "arabic", "math", "science", "social", "english", "digital", "art", "pe"),
    "middle": ("quran", "islamic", "arabic", "math", "science", "social", "english", "digital", "art", "pe", "life"),
    "first-year": ("quran", "islamic", "arabic", "math", "physics", "chemistry", "biology", "english", "social", "digital", "critical"),
    "general": ("islamic", "arabic", "math", "physics", "chemistry", "biology", "english", "social", "digital"),
    "sharia": ("tafsir", "hadith", "fiqh", "tawhid", "arabic", "english"),
    "business": ("business", "finance", "law", "math", "english", "digital"),
    "cs-eng": ("cs", "math", "physics", "engineering", "english", "capstone"),
    "health": ("biology", "chemistry", "health", "physics", "math", "english"),
    "continuing": ("islamic", "arabic", "math", "science", "social", "english", "digital"),
    "special/elementary": ("quran", "islamic", "arabic", "math", "science", "life"),
    "special/middle": ("islamic", "arabic", "math", "science", "digital", "life"),
    "special/rehab": ("life", "arabic", "math", "pe", "digital"),
    "special/teacher-guide": ("teacher",),
}
SINGLE_TERM = {"critical": "t1", "capstone": "t2"}
TRACKS = ("general", "sharia", "business", "cs-eng", "health")
GRADES = {"elementary": 6, "middle": 3, "continuing": 3}


def leaves() -> dict[str, str]:
    """Path of each leaf, and the subject list that it has."""
    made = {f"{stage}/grade-{g}": stage for stage, n in GRADES.items() for g in range(1, n + 1)}
    made["high-school/grade-1/first-year"] = "first-year"
    made |= {f"high-school/grade-{g}/{track}": track for g in (2, 3) for track in TRACKS}
    return made | {path: path for path in SUBJECTS if "/" in path}


def tree(leaves: DataFrame) -> DataFrame:
    """path, parent, depth, is_leaf of every branch and leaf above the given paths, each once; null and empty paths have none."""
    parts = leaves.where("path <> ''").select(F.split("path", "/").alias("p")).distinct()
    each = parts.select("p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("depth"))
    part = lambda n: F.concat_ws("/", F.slice("p", F.lit(1), n))
    found = each.select(part(F.col("depth")).alias("path"), F.when(F.col("depth") > 1, part(F.col("depth") - 1)).alias("parent"), "depth", (F.col("depth") == F.size("p")).alias("is_leaf"))
    return found.groupBy("path", "parent", "depth").agg(F.bool_or("is_leaf").alias("is_leaf"))


def nodes(spark: SparkSession) -> DataFrame:
    """path, parent, depth, is_leaf of the curriculum."""
    return tree(spark.createDataFrame([(path,) for path in leaves()], "path string"))


def subjects(spark: SparkSession) -> DataFrame:
    """path, subject, place, terms: one row for each subject of each leaf."""
    rows = [(path, list(SUBJECTS[kind])) for path, kind in leaves().items()]
    one = spark.createDataFrame(rows, "path string, subjects array<string>").select("path", F.posexplode("subjects").alias("place", "subject"))
    single = F.create_map(*(F.lit(x) for pair in SINGLE_TERM.items() for x in pair))
    both = F.array(*(F.lit(t) for t, _ in TERMS))
    only = F.try_element_at(single, F.col("subject"))
    return one.withColumn("terms", F.when(only.isNotNull(), F.array(only)).otherwise(both))


def resources(subjects: DataFrame) -> DataFrame:
    """One row for each subject, term in which it runs, and kind of document."""
    terms = F.array(*(F.struct(F.lit(i).alias("term"), F.lit(n).alias("term_name")) for i, n in TERMS))
    kinds = F.array(*(F.struct(F.lit(n).alias("order"), F.lit(s).alias("suffix"), F.lit(t).alias("title"), F.lit(k).alias("kind"), F.lit(f).alias("file")) for n, (s, t, k, f) in enumerate(DOCUMENTS)))
    rows = subjects.withColumn("t", F.explode(terms)).where(F.array_contains("terms", F.col("t.term"))).withColumn("d", F.explode(kinds))
    return rows.select(
        "path", "subject", F.concat_ws("-", "subject", "t.term", "d.suffix").alias("id"), "d.title", "d.kind", "d.order", "t.term", "t.term_name",
        F.concat_ws("/", F.lit(YEAR), "path", "subject", "t.term", "d.file").alias("key"),
    )


def by_key(found: DataFrame, keys: DataFrame) -> DataFrame:
    """The first resource of each asked key; both may be long, so neither is broadcast."""
    hit = found.groupBy("key").agg(F.min(F.struct("path", "id", "title", "subject")).alias("r"))
    return join_wide(keys, hit, "key").select("key", "r.path", "r.id", "r.title", "r.subject")


def trail(tree: DataFrame, path: str) -> DataFrame:
    """The nodes from the root to a path, none if the path doesn't exist."""
    parts = path.split("/")
    prefixes = ["/".join(parts[: i + 1]) for i in range(len(parts))]
    exists = tree.where(F.col("path") == path).select(F.lit(1).alias("ok")).limit(1)
    return tree.where(F.col("path").isin(prefixes)).join(F.broadcast(exists)).drop("ok").orderBy("depth")


def trails(tree: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, path, parent, depth, is_leaf: for each asked path that the tree has, the nodes from the root to it.

    Asked paths that the tree lacks have no rows; a path asked for twice has its trail once.
    """
    real = join_wide(asked.select("path").distinct(), tree.select("path"), "path", "left_semi").select(F.col("path").alias("asked"), F.split("path", "/").alias("p"))
    steps = real.select("asked", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("n"), "p").select("asked", F.concat_ws("/", F.slice("p", F.lit(1), F.col("n"))).alias("path"))
    return join_wide(steps, tree, "path").select("asked", "path", "parent", "depth", "is_leaf")


def counts(found: DataFrame) -> DataFrame:
    """Resources of each subject and term."""
    return found.groupBy("path", "subject", "term").agg(F.count("*").alias("resources"))
