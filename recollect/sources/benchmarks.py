"""Long-conversation benchmarks: sessions (question_id, session_id, at, body) and gold (question_id, question, session_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Formats of the benchmarks' dates.
DATES = ("yyyy/MM/dd (EEE) HH:mm", "yyyy/MM/dd HH:mm", "h:mm a 'on' d MMMM, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd")

LONGMEMEVAL = (
    "question_id string, question string, answer string, question_type string, question_date string, haystack_session_ids array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string>>>, haystack_dates array<string>, answer_session_ids array<string>"
)
CONVOMEM = "dialogue_id string, sessions array<struct<session_id:string,timestamp:string,turns:array<struct<speaker:string,text:string>>>>, qa array<struct<question:string,evidence_session_ids:array<string>>>"
MEMBENCH = (
    "tid string, message_list array<array<struct<sid:long,user_message:string,assistant_message:string,time:string,place:string>>>, "
    "QA struct<question:string,target_step_id:array<array<long>>,choices:map<string,string>,ground_truth:string>"
)


def parsed_date(c):
    value = F.regexp_replace(c, r"\s*\([A-Za-z]{3}\)\s*", " ")
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATES if "EEE" not in f])


def _body(turns, speaker: str, text: str):
    return F.array_join(F.transform(turns, lambda t: F.concat(t[speaker], F.lit(": "), t[text])), "\n")


def longmemeval(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(LONGMEMEVAL).option("multiLine", True).json(path)
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_sessions").alias("turns"), F.col("haystack_dates").alias("date"))
    sessions = rows.select("question_id", F.explode(zipped).alias("s"))
    sessions = sessions.select("question_id", F.col("s.id").alias("session_id"), parsed_date(F.col("s.date")).alias("at"), _body(F.col("s.turns"), "role", "content").alias("body"))
    return sessions, rows.select("question_id", "question", "question_type", F.explode("answer_session_ids").alias("session_id"))


def convomem(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(CONVOMEM).option("multiLine", True).json(path)
    sessions = rows.select(F.col("dialogue_id").alias("question_id"), F.explode("sessions").alias("s")).select("question_id", "s.session_id", parsed_date(F.col("s.timestamp")).alias("at"), _body(F.col("s.turns"), "speaker", "text").alias("body"))
    qa = rows.select("dialogue_id", F.posexplode("qa").alias("n", "q"))
    return sessions, qa.select(F.col("dialogue_id").alias("question_id"), "n", "q.question", F.explode("q.evidence_session_ids").alias("session_id"))


def membench(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.schema(MEMBENCH).option("multiLine", True).json(path)
    steps = rows.select("tid", F.posexplode("message_list").alias("session", "steps")).select("tid", "session", F.explode("steps").alias("m"))
    sessions = steps.select(F.col("tid").alias("question_id"), F.concat_ws(":", "session", "m.sid").alias("session_id"), parsed_date(F.col("m.time")).alias("at"), F.concat_ws("\n", "m.user_message", "m.assistant_message").alias("body"))
    gold = rows.select("tid", "QA.question", F.explode("QA.target_step_id").alias("g"))
    return sessions, gold.select(F.col("tid").alias("question_id"), "question", F.concat_ws(":", F.coalesce(F.get("g", 1), F.lit(0)), F.get("g", 0)).alias("session_id"))


def locomo(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Sessions are numbered keys of an object, so a dialogue is read as a map of its parts' JSON."""
    rows = spark.read.schema("sample_id string, conversation string, qa array<struct<question:string,answer:string,category:int,evidence:array<string>>>").option("multiLine", True).json(path)
    parts = rows.select("sample_id", F.from_json("conversation", "map<string,string>").alias("c"))
    own = parts.select("sample_id", "c", F.explode(F.filter(F.map_keys("c"), lambda k: k.rlike("^session_[0-9]+$"))).alias("session_id"))
    turns = F.from_json(F.col("c")[F.col("session_id")], "array<struct<speaker:string,text:string,dia_id:string>>")
    sessions = own.select(F.col("sample_id").alias("question_id"), "session_id", parsed_date(F.initcap(F.col("c")[F.concat("session_id", F.lit("_date_time"))])).alias("at"), _body(turns, "speaker", "text").alias("body"))
    qa = rows.select("sample_id", F.posexplode("qa").alias("n", "q"))
    gold = qa.select(F.col("sample_id").alias("question_id"), "n", "q.question", F.explode("q.evidence").alias("e"))
    return sessions, gold.select("question_id", "n", "question", F.concat(F.lit("session_"), F.regexp_extract("e", r"D(\d+):", 1)).alias("session_id")).distinct()
