"""Registered queries that write the library's files, read them back, or run whole benchmarks; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import responses, text, tokens, uids
from plumbline.operators import audit, hazards
from plumbline.plans import models, runner, views
from plumbline.plans.catalog import _WORDS, GRADE, _graph, query, r6
from plumbline.plans.definitions import question_test, run_test
from plumbline.plans.views import HAZARDS, STANDARDS, table
from plumbline.sources import datasets, journal, sinks
from plumbline.sources.store import shared_dir


def _place(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/queries/{uuid.uuid4().hex}/{name}"


_ODD = """p_name || ', "' || p_brand || '"' || chr(10) || p_type"""


def _odd_text():
    return F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type")


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS prompt_uid, {_ODD} AS prompt_text, {_ODD} AS evaluated_prompt_text, CAST(p_size AS VARCHAR) AS size FROM part")
def prompts_csv(spark, sf_dir):
    """Prompts through a quoted CSV file with aliased columns and context."""
    path = _place(spark, "prompts.csv")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("Release_Prompt_ID"), _odd_text().alias("Prompt_Text"), F.col("p_size").cast("string").alias("size"))
    sinks.write_csv(rows, path, ["Release_Prompt_ID", "Prompt_Text", "size"], single=False)
    return datasets.read_prompts(spark, path, context=True).select("prompt_uid", "prompt_text", "evaluated_prompt_text", F.col("context")["size"].alias("size"))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS prompt_uid, {_ODD} AS prompt_text, p_name AS evaluated_prompt_text FROM part")
def jailbreak_csv(spark, sf_dir):
    """Jailbreaks, which are judged by their seed prompt."""
    path = _place(spark, "jailbreaks.csv")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("prompt_uid"), _odd_text().alias("prompt_text"), F.col("p_name").alias("seed_prompt_text"))
    sinks.write_csv(rows, path, ["prompt_uid", "prompt_text", "seed_prompt_text"], single=False)
    return datasets.read_prompts(spark, path, jailbreak=True).select("prompt_uid", "prompt_text", "evaluated_prompt_text")


def _answered(spark, sf_dir):
    own = views.interactions(spark, sf_dir).where("response_text is not null")
    return own.select(F.concat_ws("-", "conv_id", "turn").alias("prompt_uid"), "prompt_text", F.concat(F.lit("sut"), F.col("turn") % 3).alias("sut_uid"), F.col("response_text").alias("sut_response"))


@query("SELECT conv_id || '-' || turn AS prompt_uid, prompt_text, 'sut' || turn % 3 AS sut_uid, response_text AS sut_response FROM interactions WHERE response_text IS NOT NULL", "interactions")
def responses_csv(spark, sf_dir):
    path = _place(spark, "responses.csv")
    rows = sinks.response_rows(_answered(spark, sf_dir))
    sinks.write_csv(rows, path, rows.columns, single=False)
    return datasets.read_responses(spark, path)


@query("SELECT prompt_uid, sut_uid, a AS annotator_uid, CASE a WHEN 'y_bad' THEN NOT y ELSE y END AS is_safe, CASE a WHEN 'y_bad' THEN true ELSE n % 2 = 0 END AS is_valid FROM (SELECT conv_id || '-' || turn AS prompt_uid, 'sut' || turn % 3 AS sut_uid, regexp_matches(response_text, '[yY]') AS y, length(response_text) AS n FROM interactions WHERE response_text IS NOT NULL), (VALUES ('y_bad'), ('y_good')) t(a)", "interactions")
def annotations_csv(spark, sf_dir):
    """Annotations as JSON without nulls in a CSV file; an absent validity is true."""
    path = _place(spark, "annotations.csv")
    own = _answered(spark, sf_dir).withColumnRenamed("sut_response", "response_text").withColumn("evaluated_prompt_text", F.col("prompt_text"))
    own = models.annotate(own, [models.YBadAnnotator("y_bad"), models.YGoodAnnotator("y_good")])
    valid = F.when(F.col("annotator") == "y_good", F.length("response_text") % 2 == 0)
    own = own.withColumn("annotation", F.struct("is_safe", valid.alias("is_valid"))).withColumnsRenamed({"response_text": "sut_response", "annotator": "annotator_uid"})
    rows = sinks.annotation_rows(own)
    sinks.write_csv(rows, path, rows.columns, single=False)
    return datasets.read_annotations(spark, path).select("prompt_uid", "sut_uid", "annotator_uid", "is_safe", "is_valid")


def _journal_files(spark, sf_dir):
    top = _place(spark, "journals")
    entries = views.journal(spark, sf_dir).select("seq", "message", "test", "sut", "prompt_id")
    journal.write_journal(entries.where("sut = 'sut0'"), f"{top}/journal-run-a")
    journal.write_journal(entries.where("sut = 'sut1'"), f"{top}/below/journal-run-b")
    journal.write_journal(entries.limit(5), f"{top}/other")
    return journal.read_journals(spark, top)


@query("SELECT CASE sut WHEN 'sut0' THEN 'journal-run-a' ELSE 'journal-run-b' END AS name, message, test, count(*) AS entries, count(DISTINCT prompt_id) AS prompts FROM journal GROUP BY ALL", "journal")
def journal_files(spark, sf_dir):
    """Journals below a folder, written and read; names that aren't journals' don't count."""
    own = _journal_files(spark, sf_dir)
    return own.withColumn("name", F.substring_index("journal", "/", -1)).groupBy("name", "message", "test").agg(F.count("*").alias("entries"), F.countDistinct("prompt_id").alias("prompts"))


@query("SELECT prompt_id, count(*) AS entries FROM journal WHERE message = 'queuing item' AND test = 'test3' AND sut = 'sut1' GROUP BY prompt_id", "journal")
def journal_query(spark, sf_dir):
    own = journal.query(views.journal(spark, sf_dir), "queuing item", test="test3", sut="sut1")
    return own.groupBy("prompt_id").agg(F.count("*").alias("entries"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS question, p_brand AS safe_answer FROM part")
def question_lines(spark, sf_dir):
    """Questions as JSON lines, with blank lines between."""
    path = _place(spark, "questions.jsonl")
    lines = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("question"), F.col("p_brand").alias("safe_answer"))).alias("value"), "p_size")
    lines.select(F.explode(F.when(F.col("p_size") % 3 == 0, F.array(F.lit("  "), F.col("value"))).otherwise(F.array("value"))).alias("value")).write.text(path)
    return datasets.read_questions(spark, path)


@query("SELECT line, l AS \"left\", r AS \"right\" FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS line, CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE s_name END AS l, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'of ' || s_nationkey END AS r FROM supplier) WHERE trim(l) <> '' AND r <> ''")
def paired_lines(spark, sf_dir):
    """Two text files matched by line number, without pairs that have a blank side."""
    own = table(spark, sf_dir, "supplier").repartitionByRange(4, "s_suppkey").sortWithinPartitions("s_suppkey")
    left, right = _place(spark, "left"), _place(spark, "right")
    own.select(F.when(F.col("s_suppkey") % 5 == 0, " ").otherwise(F.col("s_name")).alias("value")).write.text(left)
    own.select(F.when(F.col("s_suppkey") % 7 == 0, "").otherwise(F.concat(F.lit("of "), "s_nationkey")).alias("value")).write.text(right)
    return datasets.read_pairs(spark, left, right)


@query("SELECT 'safe_hazard-1_1-' || hazard AS reference_key, reference FROM standards", "standards")
def standards_file(spark, sf_dir):
    """Standards as a JSON file, read as a table."""
    path = _place(spark, "standards")
    pairs = F.create_map(*[F.lit(x) for h, v in STANDARDS.items() for x in (uids.reference_key(h), v)])
    spark.range(1).select(F.to_json(F.struct(F.struct(pairs.alias("reference_standards")).alias("standards"))).alias("value")).coalesce(1).write.text(path)
    return datasets.read_standards(spark, path)


_TESTS = "CASE number % 4 WHEN 0 THEN 'odd name' WHEN 1 THEN 'safe-' || hazard || '-en_us-official-1.1' ELSE 'safe-' || hazard || '-en_us-practice-1.1' END"


@query("SELECT 'job' AS job_id, CASE number % 4 WHEN 0 THEN 'odd name' ELSE hazard END AS hazard, prompt_id AS response, number % 3 = 0 AS is_safe, true AS is_valid FROM items WHERE shareable AND number % 4 <> 1", "items")
def exported_annotations(spark, sf_dir):
    """What may be exported: shareable, and not of an official prompt set."""
    path = _place(spark, "export")
    n = F.col("number") % 4
    uid = F.when(n == 0, "odd name").when(n == 1, F.concat(F.lit("safe-"), "hazard", F.lit("-en_us-official-1.1"))).otherwise(F.concat(F.lit("safe-"), "hazard", F.lit("-en_us-practice-1.1")))
    own = views.items(spark, sf_dir).select(uid.alias("test_uid"), "shareable", F.col("hazard").alias("prompt_text"), F.col("prompt_id").alias("response_text"), (F.col("number") % 3 == 0).alias("is_safe"), F.lit(True).alias("is_valid"))
    sinks.export_annotations(own, path, "job")
    return spark.read.json(path).select("job_id", "hazard", "response", "is_safe", "is_valid")


def _benchmark_rows(spark, sf_dir):
    return views.items(spark, sf_dir).select(F.col("prompt_id").alias("prompt_uid"), F.col("text").alias("prompt_text"), "hazard", "locale", "persona")


def _run(spark, sf_dir, **more):
    judges = [models.YBadAnnotator("y_bad"), models.YGoodAnnotator("y_good"), models.YBadAnnotator("y_bad_too")]
    made = runner.Benchmark(annotators=judges, merge="majority", prompt_set="practice", **more)
    suts = [models.YesNoModel("yes_no"), models.ConstantModel("mute", "")]
    given = spark.createDataFrame([(uids.reference_key(h), v) for h, v in STANDARDS.items()], "reference_key string, reference double")
    return runner.run_benchmark(_benchmark_rows(spark, sf_dir), made, suts, given)


_SAFE = f"SELECT hazard, s.sut, CASE WHEN s.sut = 'mute' OR ({_WORDS.format(c='text')}) % 2 = 1 THEN 1 ELSE 0 END AS safe FROM items, (VALUES ('yes_no'), ('mute')) s(sut) WHERE locale = 'en_us' AND trim(text, chr(32) || chr(9) || chr(10) || chr(13)) <> ''"


@query(f"SELECT sut, hazard, round(k / n, 6) AS score, n AS num_scored_items, k AS num_safe_items, {GRADE.format(s='k / n', r='((1 - k / n) / (1 - reference))')} AS numeric_grade FROM (SELECT sut, hazard, CAST(sum(safe) AS BIGINT) AS k, count(*) AS n FROM ({_SAFE}) GROUP BY ALL) JOIN standards USING (hazard)", "items", "standards")
def benchmark_run(spark, sf_dir):
    """Prompts through two models and three annotators to graded hazards; the mute model's answers are blank, so safe."""
    own = _run(spark, sf_dir).hazard_scores
    return own.select("sut", "hazard", r6("score").alias("score"), "num_scored_items", "num_safe_items", "numeric_grade")


@query(f"SELECT sut, sum(safe) / count(*) AS score FROM ({_SAFE}) GROUP BY sut", "items")
def benchmark_run_total(spark, sf_dir):
    return _run(spark, sf_dir).benchmark_scores.select("sut", "score")


@query(f"""SELECT message, count(*) AS entries FROM (SELECT unnest(['queuing item', 'fetched sut response', 'translated sut response', 'measured item quality', 'item finished']) AS message FROM ({_SAFE})
    UNION ALL SELECT unnest(['fetched annotator response', 'translated annotation', 'fetched annotator response', 'translated annotation', 'fetched annotator response', 'translated annotation']) FROM ({_SAFE})
    UNION ALL SELECT unnest(['test scored', 'hazard scored']) FROM (SELECT DISTINCT sut, hazard FROM ({_SAFE})) UNION ALL SELECT 'hazard info' FROM range({len(HAZARDS)}) UNION ALL SELECT unnest(['starting run', 'running pipeline', 'finished run'])) GROUP BY message""", "items")
def run_journal(spark, sf_dir):
    """Entries by message of the journal that a run leaves."""
    path = runner.leave_journal(_run(spark, sf_dir), _place(spark, "runs"), "one")
    return journal.read_journals(spark, path.rpartition("/")[0]).groupBy("message").agg(F.count("*").alias("entries"))


@query(f"SELECT 'journal-run-one' AS journal, count(*) * (6 + 9 + 1) AS checks, CAST(0 AS BIGINT) AS failed, true AS passed FROM (SELECT DISTINCT sut, hazard FROM ({_SAFE}))", "items")
def run_journal_audit(spark, sf_dir):
    """Every check of that journal passes: six a test and model, three for each annotator, one a hazard and model."""
    path = runner.leave_journal(_run(spark, sf_dir), _place(spark, "runs"), "one")
    found = audit.summary(audit.check_journals(journal.read_journals(spark, path.rpartition("/")[0])))
    return found.withColumn("journal", F.substring_index("journal", "/", -1))


@query("SELECT hazard, round(min(k / n), 6) AS reference FROM (SELECT hazard, number // 36 % 3 AS sut, count(*) FILTER (NOT regexp_matches(text, '[yY]')) AS k, count(*) AS n FROM items GROUP BY ALL) GROUP BY hazard", "items")
def calibrated_systems(spark, sf_dir):
    """The least score of three systems for each hazard."""
    own = views.items(spark, sf_dir).withColumn("sut", (F.floor(F.col("number") / 36) % 3).cast("string"))
    own = own.withColumn("value", (~F.col("text").rlike("[yY]")).cast("double")).withColumn("error", F.lit(None).cast("string"))
    out = hazards.hazard_scores(hazards.persona_stats(own, ["hazard", "sut"]), ["hazard", "sut"])
    return hazards.calibrated(out, ["0", "1", "2"]).select("hazard", r6("reference").alias("reference"))


@query("""SELECT p_partkey, kind, CASE WHEN kind = 'chat' AND p_size % 3 = 0 THEN NULL WHEN kind = 'candidates' AND p_size % 3 = 1 THEN '' WHEN kind = 'moderated' AND p_size % 2 = 0 THEN '' WHEN kind = 'blocks' AND p_size % 5 = 0 THEN NULL ELSE p_name END AS text,
    (kind = 'chat' AND p_size % 3 = 0) OR (kind = 'blocks' AND p_size % 5 = 0) AS failed FROM part, (VALUES ('chat'), ('completion'), ('candidates'), ('moderated'), ('blocks')) t(kind)""")
def provider_answers(spark, sf_dir):
    """Raw answers of five kinds to texts, refusals and errors."""
    n, name = F.col("p_size"), F.col("p_name")
    blank = F.array().cast("array<struct<text: string>>")
    choice = F.struct(F.struct(name.alias("content")).alias("message"))
    raw = {
        "chat": (responses.chat_completion, F.struct(F.when(n % 3 == 0, F.array(choice, choice)).otherwise(F.array(choice)).alias("choices"))),
        "completion": (responses.text_completion, F.struct(F.array(F.struct(name.alias("text"))).alias("choices"))),
        "candidates": (responses.candidates, F.struct(F.array(F.struct(F.when(n % 3 == 1, "SAFETY").otherwise("STOP").alias("finish_reason"), F.struct(F.when(n % 3 == 1, blank).otherwise(F.array(F.struct(name.alias("text")))).alias("parts")).alias("content"))).alias("candidates"))),
        "moderated": (responses.moderated, F.struct(F.struct(F.array(F.struct((n % 2 == 0).alias("flagged"))).alias("results")).alias("moderation_response"), F.struct(F.struct(F.struct(name.alias("text")).alias("content")).alias("completion_message")).alias("sut_response"))),
        "blocks": (responses.content_blocks, F.struct(F.array(F.struct(F.when(n % 5 == 0, "tool").otherwise("text").alias("type"), name.alias("text"))).alias("content"))),
    }
    each = F.array(*[F.struct(F.lit(k).alias("kind"), f(F.to_json(r)).alias("a")) for k, (f, r) in raw.items()])
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(each).alias("e")).select("p_partkey", "e.kind", "e.a.text", F.col("e.a.error").isNotNull().alias("failed"))


@query("SELECT p_partkey, p_name AS token, CAST(p_size AS DOUBLE) AS logprob, 'answer' AS text FROM part")
def provider_probabilities(spark, sf_dir):
    top = F.struct(F.array(F.struct(F.array(F.struct(F.col("p_name").alias("token"), F.col("p_size").cast("double").alias("logprob"))).alias("top_logprobs"))).alias("content"))
    raw = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("answer").alias("content")).alias("message"), top.alias("logprobs"))).alias("choices")))
    own = table(spark, sf_dir, "part").select("p_partkey", responses.chat_completion(raw, True).alias("a"))
    first = F.col("a.top_logprobs")[0][0]
    return own.select("p_partkey", first.token.alias("token"), first.logprob.alias("logprob"), "a.text")


@query("SELECT p_partkey, p_name, p_size FROM part")
def envelopes(spark, sf_dir):
    """Typed JSON envelopes, closed and opened."""
    own = table(spark, sf_dir, "part").select("p_partkey", responses.envelope("Item", F.struct("p_name", "p_size")).alias("e"))
    return own.select("p_partkey", responses.opened(F.col("e"), "Item", "p_name: string, p_size: int").alias("d")).select("p_partkey", "d.p_name", "d.p_size")


@query("SELECT count(*) AS num_items, CAST(sum(CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END) AS DOUBLE) AS num_safe FROM part")
def question_scores(spark, sf_dir):
    """A question test on a model that always gives one answer."""
    questions = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("question"), F.col("p_brand").alias("safe_answer"))
    done = run_test(question_test("questions", questions), models.ConstantModel("one", "Brand#1")).items
    return done.agg(F.count("value").alias("num_items"), F.sum("value").alias("num_safe"))


@query("SELECT n_nationkey, lower(n_name[1:2]) || '_' || upper(n_name[3:4]) AS locale, 'set_' || n_nationkey AS prompt_set, sha256(n_name) AS digest FROM nation")
def small_names(spark, sf_dir):
    own = table(spark, sf_dir, "nation")
    locale = F.concat(F.upper(F.substring("n_name", 1, 2)), F.lit("_"), F.lower(F.substring("n_name", 3, 2)))
    url = F.concat(F.lit("https://example.org/a.b/set_"), "n_nationkey", F.lit(".csv?x=1"))
    return own.select("n_nationkey", text.display_locale(locale).alias("locale"), text.prompt_set_name(url).alias("prompt_set"), F.sha2(F.col("n_name"), 256).alias("digest"))


@query(f"SELECT doc_id, CAST(({_WORDS.format(c='text')}) + CASE WHEN regexp_matches(text, '[ \\t\\n\\r]$') THEN 1 ELSE 0 END AS INTEGER) AS tokens FROM documents")
def token_counts(spark, sf_dir):
    """Tokens of the whitespace tokenizer: words, and what white space ends a text."""
    return table(spark, sf_dir, "documents").select("doc_id", tokens.token_count(F.col("text")).alias("tokens"))


@query("SELECT * FROM (VALUES ('refusal', 0.5::DOUBLE, 0.25::DOUBLE), ('refusal -> lower -> score', 1.5, 0.25), ('refusal -> score', 1.5, 0.25)) t(path, fixed, latency)")
def graph_paths(spark, sf_dir):
    """What each path through the graph may cost."""
    costs = _graph().potential_costs()
    return spark.createDataFrame([(p, float(c.fixed), float(c.latency)) for p, c in costs.items()], "path string, fixed double, latency double")


@query("SELECT sut, persona, round(sum(safe) / count(*), 6) AS score, count(*) AS num_scored_items, 'N/A' AS text_grade FROM (SELECT s.sut, persona, CASE WHEN s.sut = 'no' OR NOT regexp_matches(seed, '[yY]') THEN 1 ELSE 0 END AS safe FROM (SELECT CASE number % 2 WHEN 0 THEN 'jailbreak' ELSE 'naive' END AS persona, hazard AS seed FROM items WHERE locale = 'en_us'), (VALUES ('no'), ('yes')) s(sut)) GROUP BY ALL".replace("NOT regexp_matches(seed, '[yY]')", "false"), "items")
def security_run(spark, sf_dir):
    """Naive prompts and jailbreaks through two models, scored without a grade."""
    own = views.items(spark, sf_dir)
    rows = {p: own.where(F.col("number") % 2 == i).select(F.col("prompt_id").alias("prompt_uid"), F.concat(F.lit("do "), "hazard").alias("prompt_text"), F.col("hazard").alias("seed_prompt_text"), F.lit("").alias("bijection_mapping"), F.lit("role play").alias("attack"), "locale") for i, p in enumerate(("jailbreak", "naive"))}
    suts = [models.ConstantModel("no", "no"), models.ConstantModel("yes", "yes")]
    run = runner.run_security(rows, "en_us", suts, [models.YBadAnnotator("y_bad")])
    return run.hazard_scores.select("sut", "persona", r6("score").alias("score"), "num_scored_items", F.lit("N/A").alias("text_grade"))


@query("SELECT a.event_id AS request, b.event_id AS response FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts::TIMESTAMP >= a.ts::TIMESTAMP AND b.ts::TIMESTAMP <= a.ts::TIMESTAMP + INTERVAL 1 HOUR")
def matched_requests(spark, sf_dir):
    """Requests with what others posted for them within an hour."""
    from plumbline.streaming.journal import matched_responses

    own = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    asked = own.where("event_type = 'view'").select(F.col("user_id").alias("request_id"), F.col("ts").alias("asked"), F.col("event_id").alias("request"))
    answered = own.where("event_type = 'click'").select(F.col("user_id").alias("response_id"), F.col("ts").alias("answered"), F.col("event_id").alias("response"))
    return matched_responses(asked, answered).select("request", "response")
