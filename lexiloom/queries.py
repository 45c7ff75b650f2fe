"""Registered queries of the extraction engine, each over its whole table, and their DuckDB forms."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import backends, chat, engine, extract, ledger, quality, runtime, score, segment
from lexiloom.plans import specs as S
from lexiloom.sources import html, images, serde
from lexiloom.streaming import streams

CHUNK = 10
MODELS = [S.Model("rules/small")]
BACKENDS = {"extractor_text": backends.RuleBackend()}

LICENCE = S.Aspect("Licence", "Licensing terms", rule="(?i)licen[cs]e")
CONTACT = S.Aspect("Contact", "How to reach someone", rule="@", reference_depth="sentences")
DIGITS = S.Aspect("Digits", "Text with figures", rule="[0-9]", aspects=(S.Aspect("Long digits", "Long figures", rule="[0-9]{6}"),))
SECRETS = S.Aspect("Secrets", "Passwords and tokens", rule="password|token", concepts=(S.StringConcept("Secret value", "What stands behind", rule={"pattern": "(?:password|token)[ =\"]+([A-Za-z0-9]+)", "group": 1}),))
ADDRESS = S.StringConcept("Address", "E-mail address", rule="[A-Za-z0-9_.]+@[A-Za-z0-9.]+", add_references=True)
HAS_SECRET = S.BooleanConcept("Has secret", "It holds a secret", rule="password|token")
AMOUNT = S.NumericalConcept("Amount", "A figure", numeric_type="int", rule="[0-9]{2,}")
GRADE = S.RatingConcept("Grade", "How telling it is", (1, 5), rule={"ratings": {5: "(?i)licen[cs]e", 3: "@", 1: "[0-9]"}})
TOPIC = S.LabelConcept("Topic", "What it is about", ("secret", "contact", "figures"), rule={"labels": {"secret": "password|token", "contact": "@", "figures": "[0-9]"}})
TOPICS = S.LabelConcept("Topics", "All it is about", ("secret", "contact", "figures"), "multi_label", rule={"labels": {"secret": "password|token", "contact": "@", "figures": "[0-9]"}})
FIRST_AMOUNT = S.NumericalConcept("First amount", "The first figure", numeric_type="int", rule="[0-9]{2,}", singular=True)
ORDER_DATE = S.DateConcept("Order date", "Day of the order", rule="[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}")
ORDER = S.JsonObjectConcept("Order", "The order", {"number": str, "status": str}, rule={"fields": {"number": "(?:number )([0-9]+)", "status": "(?:status )([A-Z])"}, "group": 1})
PRICE = S.NumericalConcept("Price", "Total price", numeric_type="float", rule={"pattern": "total ([0-9]+[.][0-9]+)", "group": 1})


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.spread(runtime.table(spark, sf_dir, "documents"))


def _run(frame: DataFrame, aspects=(), concepts=(), what="all", **settings) -> extract.Extraction:
    return extract.extract(frame, S.Pipeline(aspects, concepts), MODELS, BACKENDS, engine.Settings(**settings), what, keep_prompts=False)


def _items(frame: DataFrame, aspects=(), concepts=(), **settings) -> DataFrame:
    return _run(frame, aspects, concepts, **settings).items


def _order_docs(spark, sf_dir) -> DataFrame:
    o = runtime.spread(runtime.table(spark, sf_dir, "orders"))
    line = F.format_string("Order number %d with status %s came on %s, total %s.", "o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "d-M-yyyy"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return o.select(F.col("o_orderkey").alias("doc_id"), line.alias("text"))


class Flaky:
    """Useless replies for the first ``n mod 6`` attempts, n coming from the MD5 of the call's first paragraph."""

    needs_prompt = False

    def complete(self, prompt, payload):
        n = int(hashlib.md5(payload["paras"][0].encode()).hexdigest()[:2], 16)
        return backends.RuleBackend().complete(prompt, payload) if payload["attempt"] >= n % 6 else "I would rather not"


def retry_outcome(spark, sf_dir) -> DataFrame:
    """Calls and outcome of every document, its paragraphs ten a call, with a model and a fallback that answer late."""
    model = S.Model("rules/small", retries_invalid=2, fallback=S.Model("rules/large", is_fallback=True, retries_invalid=1))
    got = extract.extract(docs(spark, sf_dir), S.Pipeline(concepts=(AMOUNT,)), [model], {"extractor_text": (Flaky(), Flaky())}, engine.Settings(paragraphs_per_call=CHUNK, raise_errors=False), keep_prompts=False)
    calls = got.ledger.groupBy("doc_id").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("is_fallback").cast("long")).alias("fallback_calls"))
    return calls.join(got.status.select("doc_id", "processed"), "doc_id")


def _document_ledger(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id") % 3
    model = F.when(k == 0, "acme/small").when(k == 1, "acme/large").otherwise("acme/free")
    tokens = F.ceil(F.length("text") / 4).cast("long")
    return docs(spark, sf_dir).select("doc_id", model.alias("model"), F.lit("extractor_text").alias("llm_role"), (k == 1).alias("is_fallback"), tokens.alias("in_tokens"), F.floor(tokens / 7).cast("long").alias("out_tokens"))


def _prices(spark) -> DataFrame:
    return spark.createDataFrame([("acme/small", "extractor_text", False, "0.40", "1.60"), ("acme/large", "extractor_text", True, "2.5", "10"), ("acme/free", "extractor_text", False, None, None)], "model string, llm_role string, is_fallback boolean, a string, b string").select("model", "llm_role", "is_fallback", F.col("a").cast("decimal(18,6)").alias("price_in"), F.col("b").cast("decimal(18,6)").alias("price_out"))


def spec_groups(spark, sf_dir) -> DataFrame:
    """Aspects and concepts of one pipeline for each language of the corpus, grouped by the five parameters."""
    langs = docs(spark, sf_dir).select("lang").distinct()
    rows = [(i, d, j) for i, (d, j) in enumerate([("paragraphs", False), ("sentences", False), ("paragraphs", False), ("paragraphs", True), ("sentences", False), ("paragraphs", False)])]
    specs = spark.createDataFrame(rows, "ord int, reference_depth string, add_justifications boolean")
    found = langs.crossJoin(F.broadcast(specs)).groupBy("lang", "reference_depth", "add_justifications")
    listed = F.array_sort(F.collect_list("ord"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.array_join(listed.cast("array<string>"), ",").alias("specs"))


def call_plan_counts(spark, sf_dir) -> DataFrame:
    plan = extract.call_plan(docs(spark, sf_dir), S.Pipeline((LICENCE, CONTACT, DIGITS), (ADDRESS, HAS_SECRET, AMOUNT)), MODELS, engine.Settings(paragraphs_per_call=CHUNK))
    return plan.groupBy("doc_id", "owner_kind").agg(F.count(F.lit(1)).alias("calls"), (F.max("text_chunk") + 1).cast("long").alias("text_chunks"))


def missing_roles(spark, sf_dir) -> DataFrame:
    """Roles that sources of the corpus ask for and no model has."""
    role = F.element_at(F.array(*[F.lit(r) for r in S.ROLES]), (F.xxhash64("source") * 0 + F.length("source") % 6 + 1).cast("int"))
    wanted = docs(spark, sf_dir).select(role.alias("llm_role")).distinct()
    have = spark.createDataFrame([("extractor_text",), ("reasoner_text",)], "llm_role string")
    return wanted.join(F.broadcast(have), "llm_role", "left_anti")


def parse_validity(spark, sf_dir) -> DataFrame:
    """Replies that hold whole texts: bare arrays, fenced ones, with thoughts, scalars, broken ones; by the text's length."""
    k = F.length("text") % 6
    body = F.concat(F.lit('[{"concept_id": "C0", "extracted_items": '), F.to_json(F.array("text")), F.lit("}]"))
    reply = (
        F.when(k == 0, body)
        .when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(k == 2, F.concat(F.lit("<think>so</think>\n"), body))
        .when(k == 3, F.lit("42"))
        .when(k == 4, F.concat(body, F.lit("]")))
        .otherwise(F.concat(F.lit("<think>"), "text", F.lit("</think>")))
    )
    v = T.parsed_json(T.without_thinking(F.col("reply")))
    got = docs(spark, sf_dir).select("doc_id", reply.alias("reply")).select("doc_id", v.alias("v"))
    return got.select("doc_id", F.col("v").isNotNull().alias("valid"), F.coalesce(F.md5(F.try_variant_get("v", "$[0].extracted_items[0]", "string")), F.lit("")).alias("value_md5"))


def structural_ids(spark, sf_dir) -> DataFrame:
    """Ids of every sentence as prompts number them, read back; a sentence's id is no paragraph's."""
    s = segment.sentences(docs(spark, sf_dir))
    para = F.concat(F.lit("P"), F.col("para_idx").cast("string"))
    sent = F.concat(para, F.lit("-S"), F.col("sent_idx").cast("string"))
    index = lambda c, letter: T.structural_index(c, letter).cast("long")
    return s.select("doc_id", long("para_idx"), index(para, "P").alias("para"), index(sent, "S").alias("sent"), index(sent, "P").alias("wrong"), index(F.concat(F.lit("C"), F.length("raw_text").cast("string")), "C").alias("concept"))


def usage_of_calls(spark, sf_dir) -> DataFrame:
    """Calls and tokens that an extraction over all documents really made, ten paragraphs a call."""
    got = extract.extract(docs(spark, sf_dir), S.Pipeline(concepts=(ADDRESS,)), MODELS, BACKENDS, engine.Settings(paragraphs_per_call=CHUNK))
    return ledger.usage(got.ledger).select("model", "calls", "in_tokens")


def chat_replay(spark, sf_dir) -> DataFrame:
    out = chat.replay(runtime.table(spark, sf_dir, "conversations"), count_reply, "Be brief.")
    return out.select("conv_id", F.col("seq").cast("long").alias("seq"), "role", "content")


def count_reply(messages):
    return f"{len(messages)} so far"


def lookup(key: int) -> str:
    """Look something up.

    :param key: what to look for
    """
    return f"entry {key}"


def tool_rounds(spark, sf_dir) -> DataFrame:
    """A model that asks for a tool once for each turn of a conversation: rounds done, -1 if over the limit."""
    turns = runtime.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    model = S.Model("rules/small", tools=("lookup",), tool_max_rounds=5)

    def one(n: int) -> int:
        def complete(messages, allowed):
            done = sum(1 for m in messages if m["role"] == "tool")
            return {"content": "done"} if done >= n else {"content": None, "tool_calls": [{"id": f"t{done}", "name": "lookup", "arguments": f'{{"key": {done}}}'}]}

        session = chat.Session()
        try:
            chat.chat(session, "go", complete, model, tools={"lookup": lookup})
        except chat.ToolError:
            return -1
        return sum(1 for m in session.messages if m["role"] == "tool")

    @F.pandas_udf("long")
    def rounds(n: pd.Series) -> pd.Series:
        return n.map(one)

    runtime.prepare(spark)
    return turns.select("conv_id", rounds("n").alias("rounds"))


def _targets(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", "lang").join(runtime.table(spark, sf_dir, "labels"), "doc_id")


def presence(spark, sf_dir) -> DataFrame:
    return score.presence(_targets(spark, sf_dir), F.col("quality") == 1, F.col("toxic") == 0, ["lang"])


def judge(spark, sf_dir) -> DataFrame:
    reply = F.format_string('{"rating": %d, "justification": "as labelled"}', F.col("quality") * 3 + (1 - F.col("toxic")) * 2)
    return score.ratings_percent(score.judged(_targets(spark, sf_dir).withColumn("reply", reply)), "rating", ["lang"])


def overall(spark, sf_dir) -> DataFrame:
    both = presence(spark, sf_dir).join(judge(spark, sf_dir), "lang")
    return score.overall(both, [["must_have", "must_not_have"], ["rating_percent"]]).select("lang", "overall")


def grounding(spark, sf_dir) -> DataFrame:
    """Benchmark passages and the documents that hold them whole, found in one pass over each text."""
    items = runtime.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    hits = score.passages_in(docs(spark, sf_dir), items)
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


def image_dedup(spark, sf_dir) -> DataFrame:
    """Image rows made of pages, a type's magic number and the page's own bytes: equal content once a host."""
    k = F.length("html") % 3
    head = F.when(k == 0, F.unhex(F.lit("FFD8FFE0"))).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.unhex(F.lit("524946460000000057454250")))
    content = F.concat(head, F.encode(F.regexp_extract("html", "<p>([^<]*)", 1), "utf-8"))
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    rows = runtime.table(spark, sf_dir, "pages").select(host.alias("doc_id"), F.col("page_id").alias("img_idx"), content.alias("content"))
    twice = rows.unionByName(rows.withColumn("img_idx", F.col("img_idx") + 1_000_000))  # every picture stands again later
    encoded = twice.select("doc_id", "img_idx", images.mime_of(F.col("content")).alias("mime_type"), F.base64("content").alias("base64"))
    return images.distinct_images(encoded).select("doc_id", "img_idx", "mime_type", F.md5(F.unbase64("base64")).alias("content_md5"))


def json_roundtrip(spark, sf_dir) -> DataFrame:
    frame = segment.with_paragraphs(docs(spark, sf_dir))
    return serde.documents_from_json(serde.documents_json(frame)).select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "raw_text")


def stream_paragraphs(spark, sf_dir) -> DataFrame:
    """Paragraphs by way of a stream over the documents' files, processed once."""
    at = runtime.shared_dir(spark, "stream")
    source = streams.document_stream(spark, f"{sf_dir}/documents.parque[t]", docs(spark, sf_dir).schema)
    streams.run_available(streams.paragraph_stream(source), f"{at}/out", f"{at}/state")
    return spark.read.schema("doc_id long, para_idx int, raw_text string").parquet(f"{at}/out").select("doc_id", F.col("para_idx").cast("long").alias("para_idx"), "raw_text")


def extract_all(spark, sf_dir) -> DataFrame:
    """The flagship: aspects, sub-aspects, an aspect's concept and document concepts, all items as text."""
    items = _items(docs(spark, sf_dir), (LICENCE, CONTACT, DIGITS, SECRETS), (ADDRESS, HAS_SECRET, AMOUNT), paragraphs_per_call=CHUNK)
    value = F.coalesce("v_str", F.col("v_bool").cast("string"), F.col("v_int").cast("string"))
    return items.groupBy("owner").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.length(value)).alias("n_chars"))


def _aspect_rows(items: DataFrame) -> DataFrame:
    return items.select("doc_id", "owner", F.col("ref_paras")[0].cast("long").alias("para_idx"), F.col("v_str").alias("value"))


def _typed(items: DataFrame, value) -> DataFrame:
    return items.select("doc_id", F.col("item_idx").cast("long").alias("item_idx"), value.alias("value"))


def rebuilt(frame: DataFrame) -> DataFrame:
    """Documents with text, put together again of their paragraphs; the one-element array keeps the work in one place."""
    whole = segment.from_paragraphs(segment.with_paragraphs(frame.select("doc_id", "text")))
    return segment.unrolled(whole, ["doc_id"], F.filter(F.array("raw_text"), lambda t: F.length(t) > 0), "at", "raw_text").drop("at")


def repeats_looked_up(frame: DataFrame) -> DataFrame:
    """All positions of the paragraphs that stand more than once in their document."""
    paras = segment.paragraphs(frame)
    return segment.position_of_paragraph(paras, segment.repeated(paras).select("doc_id", "raw_text")).select("doc_id", "raw_text", long("para_idx"))


def turns_without_answers(spark, sf_dir) -> DataFrame:
    """Turns whose role is that of the turn before, once assistant turns of an odd length are gone."""
    left = runtime.table(spark, sf_dir, "conversations").where("role <> 'assistant' OR length(text) % 2 = 0")
    return chat.ordered(left).where("role = role_before").select("conv_id", "turn", "role")


def first_positions(sents: DataFrame) -> DataFrame:
    """Sentences that stand more than once in a document, with the first place (one number, so that hashing aggregates)."""
    place = F.col("para_idx").cast("long") * (1 << 31) + F.col("sent_idx")
    found = sents.groupBy("doc_id", "raw_text").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.select("doc_id", "raw_text", F.expr("at DIV 2147483648").alias("para_idx"), (F.col("at") % (1 << 31)).alias("sent_idx"), "n")


def long(c: str):
    return F.col(c).cast("long").alias(c)


QUERIES = {
    "paragraphs_split": lambda s, d: segment.paragraphs(docs(s, d)).select("doc_id", long("para_idx"), "raw_text"),
    "paragraphs_clean_collapse": lambda s, d: segment.paragraphs(docs(s, d)).select("doc_id", long("para_idx"), T.clean_for_prompt(F.col("raw_text"), False).alias("cleaned")),
    "documents_clean_preserve": lambda s, d: docs(s, d).select("doc_id", T.clean_for_prompt(F.col("text")).alias("cleaned")),
    "sentences_split": lambda s, d: segment.sentences(docs(s, d)).select("doc_id", long("para_idx"), long("sent_idx"), "raw_text"),
    "documents_rebuilt": lambda s, d: rebuilt(docs(s, d)),
    "paragraph_position_lookup": lambda s, d: repeats_looked_up(docs(s, d)),
    "sentence_position_lookup": lambda s, d: first_positions(segment.sentences(docs(s, d))),
    "duplicate_paragraph_positions": lambda s, d: segment.repeated(segment.paragraphs(docs(s, d))).select("doc_id", "raw_text", "n", long("first_idx"), long("last_idx")),
    "paragraph_chunks": lambda s, d: segment.chunk_sizes(docs(s, d), CHUNK).withColumn("text_chunk", F.col("text_chunk").cast("long")),
    "paragraph_order_check": lambda s, d: segment.order_check(segment.with_paragraphs(docs(s, d))).select("doc_id", "in_order", F.size("paras").cast("long").alias("n_paras")),
    "spec_groups": spec_groups,
    "call_plan_counts": call_plan_counts,
    "missing_roles": missing_roles,
    "aspect_paragraph_extract": lambda s, d: _aspect_rows(_items(docs(s, d), (LICENCE,), paragraphs_per_call=CHUNK)),
    "aspect_sentence_extract": lambda s, d: _items(docs(s, d), (CONTACT,)).select("doc_id", F.col("ref_sents")[0]["p"].cast("long").alias("para_idx"), F.col("ref_sents")[0]["s"].cast("long").alias("sent_idx"), F.col("v_str").alias("value")),
    "aspect_sentence_rollup": lambda s, d: _run(docs(s, d), (CONTACT,)).status.where("size(ref_paras) > 0").select("doc_id", F.size("ref_paras").cast("long").alias("n_paras"), F.size("ref_sents").cast("long").alias("n_sents")),
    "sub_aspect_extract": lambda s, d: _aspect_rows(_items(docs(s, d), (DIGITS,), paragraphs_per_call=CHUNK)),
    "concept_string": lambda s, d: _typed(_items(docs(s, d), concepts=(ADDRESS,)), F.col("v_str")),
    "concept_boolean": lambda s, d: _typed(_items(docs(s, d), concepts=(HAS_SECRET,)), F.col("v_bool")),
    "concept_numerical": lambda s, d: _typed(_items(docs(s, d), concepts=(AMOUNT,)), F.col("v_int")),
    "concept_numerical_float": lambda s, d: _typed(_items(_order_docs(s, d), concepts=(PRICE,)), F.col("v_float")),
    "concept_rating": lambda s, d: _typed(_items(docs(s, d), concepts=(GRADE,)), F.col("v_int")),
    "concept_date": lambda s, d: _typed(_items(_order_docs(s, d), concepts=(ORDER_DATE,)), F.col("v_date")),
    "concept_label_multi_class": lambda s, d: _typed(_items(docs(s, d), concepts=(TOPIC,)), F.array_join("v_labels", ",")),
    "concept_label_multi_label": lambda s, d: _typed(_items(docs(s, d), concepts=(TOPICS,)), F.array_join("v_labels", ",")),
    "concept_json_object": lambda s, d: _items(_order_docs(s, d), concepts=(ORDER,)).select("doc_id", F.get_json_object("v_json", "$.number").alias("number"), F.get_json_object("v_json", "$.status").alias("status")),
    "concept_from_aspect": lambda s, d: _typed(_items(docs(s, d), (SECRETS,)).where("owner_kind = 'string'"), F.col("v_str")),
    "concept_refs": lambda s, d: _items(docs(s, d), concepts=(ADDRESS,), paragraphs_per_call=CHUNK).groupBy("doc_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ref_paras")))).cast("array<string>"), ",").alias("paras")),
    "singular_first_chunk": lambda s, d: _typed(_items(docs(s, d), concepts=(FIRST_AMOUNT,), paragraphs_per_call=CHUNK), F.col("v_int")),
    "extract_all_items": extract_all,
    "parse_envelope_validity": parse_validity,
    "structural_id_parse": structural_ids,
    "usage_of_calls": usage_of_calls,
    "usage_by_model": lambda s, d: ledger.usage(_document_ledger(s, d), _prices(s)),
    "usage_of_role": lambda s, d: ledger.of_role(ledger.usage(_document_ledger(s, d)), "extractor_text"),
    "cost_by_model": lambda s, d: ledger.cost(_document_ledger(s, d), _prices(s)).select("model", F.col("cost_in").cast("double").alias("cost_in"), F.col("cost_out").cast("double").alias("cost_out"), F.col("cost_total").cast("double").alias("cost_total")),
    "retry_fallback_outcome": retry_outcome,
    "chat_system_first": lambda s, d: chat.session_checks(runtime.table(s, d, "conversations")).withColumn("late_system", F.col("late_system").cast("long")),
    "chat_turn_validity": turns_without_answers,
    "chat_history_length": lambda s, d: chat.histories(runtime.table(s, d, "conversations")),
    "chat_unanswered": lambda s, d: chat.unanswered(runtime.table(s, d, "conversations")),
    "chat_replay": chat_replay,
    "tool_loop_rounds": tool_rounds,
    "presence_scores": presence,
    "judge_scores": judge,
    "overall_score": overall,
    "benchmark_grounding": grounding,
    "html_to_paragraphs": lambda s, d: segment.paragraphs(html.documents(runtime.table(s, d, "pages"))).select("doc_id", long("para_idx"), "raw_text"),
    "html_links": lambda s, d: html.links(runtime.table(s, d, "pages")).withColumn("link_idx", F.col("link_idx").cast("long")),
    "html_headings_md": lambda s, d: html.headings(runtime.table(s, d, "pages")).withColumn("heading_idx", F.col("heading_idx").cast("long")),
    "docs_unique_names": lambda s, d: quality.repeated_values(docs(s, d).select("lang", F.col("text").alias("name")), "name", ["lang"]),
    "image_dedup": image_dedup,
    "blank_documents": lambda s, d: quality.blank(docs(s, d).select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.regexp_replace("text", r"[^\s]", "")).otherwise(F.col("text")).alias("text"))).select("doc_id"),
    "document_json_roundtrip": json_roundtrip,
    "prompt_length_over_context": lambda s, d: docs(s, d).select("doc_id", F.ceil(F.length(T.clean_for_prompt(F.col("text"))) / 4).alias("tokens")).where("tokens > 500"),
    "sentences_in_paragraphs": lambda s, d: quality.foreign_sentences(segment.paragraphs(docs(s, d)), segment.sentences(docs(s, d))).groupBy().agg(F.count(F.lit(1)).alias("n_foreign")),
    "events_tumbling": lambda s, d: streams.tumbling(runtime.table(s, d, "events"), "ts", "event_type", "value", "1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total")),
    "stream_paragraphs": stream_paragraphs,
}

_PARAS = r"""p0 AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[\r\n]+')) AS raw, generate_subscripts(regexp_split_to_array(text, '[\r\n]+'), 1) AS i FROM @DOCS),
p1 AS (SELECT doc_id, i, regexp_replace(raw, '^@WS+|@WS+$', '', 'g') AS raw_text FROM p0),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS para_idx, raw_text FROM p1
  WHERE length(regexp_replace(regexp_replace(raw_text, '@CTL', '', 'g'), '@WS+', '', 'g')) > 0)"""
_SENTS = r""", s0 AS (SELECT doc_id, para_idx, unnest(regexp_extract_all(raw_text, '[^.!?]+[.!?]*')) AS raw, generate_subscripts(regexp_extract_all(raw_text, '[^.!?]+[.!?]*'), 1) AS i FROM paras),
s1 AS (SELECT doc_id, para_idx, i, regexp_replace(raw, '^@WS+|@WS+$', '', 'g') AS raw_text FROM s0),
sents AS (SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id, para_idx ORDER BY i) - 1 AS sent_idx, raw_text FROM s1
  WHERE length(regexp_replace(regexp_replace(raw_text, '@CTL', '', 'g'), '@WS+', '', 'g')) > 0)"""


def _sql(body: str, sents: bool = False, docs: str = "documents", more: str = "") -> str:
    text = "WITH " + more + _PARAS + (_SENTS if sents else "") + "\n" + body
    return text.replace("@DOCS", docs).replace("@WS", T.WS_RE2).replace("@CTN", T.CONTROL_BUT_NEWLINE_RE2).replace("@CTL", T.CONTROL_RE2)


def _plain(body: str) -> str:
    return body.replace("@WS", T.WS_RE2).replace("@CTN", T.CONTROL_BUT_NEWLINE_RE2).replace("@CTL", T.CONTROL_RE2)


_PRESERVE = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '@CTN', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^@WS+|@WS+$', '', 'g')"
_MATCHES = "(SELECT doc_id, para_idx, unnest(m) AS m, generate_subscripts(m, 1) AS k FROM (SELECT doc_id, para_idx, regexp_extract_all(raw_text, '{pattern}', {group}) AS m FROM paras) q)"
_ITEM = "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, k) - 1 AS item_idx, {value} AS value FROM " + _MATCHES + " q"
_FIRST = "SELECT doc_id, 0::BIGINT AS item_idx, arg_min({value}, para_idx) AS value FROM paras WHERE {where} GROUP BY doc_id"
_TOPIC = "CASE WHEN regexp_matches(raw_text, 'password|token') THEN 'secret' WHEN contains(raw_text, '@') THEN 'contact' ELSE 'figures' END"
_TOPICS = "array_to_string(list_filter([CASE WHEN regexp_matches(raw_text, 'password|token') THEN 'secret' END, CASE WHEN contains(raw_text, '@') THEN 'contact' END, CASE WHEN regexp_matches(raw_text, '[0-9]') THEN 'figures' END], lambda x: x IS NOT NULL), ',')"
_LEDGER = """l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'acme/small' WHEN 1 THEN 'acme/large' ELSE 'acme/free' END AS model, 'extractor_text' AS llm_role, doc_id % 3 = 1 AS is_fallback,
  CAST(ceil(length(text) / 4.0) AS BIGINT) AS in_tokens FROM documents), t AS (SELECT *, CAST(floor(in_tokens / 7.0) AS BIGINT) AS out_tokens FROM l)"""
_COUNTS = "n AS (SELECT doc_id, count(*) AS n FROM paras GROUP BY doc_id)"
_SCORES = """t AS (SELECT d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT lang, CASE WHEN count(*) FILTER (toxic = 0) = 0 THEN 0.0::DOUBLE ELSE round_even(100.0::DOUBLE * count(*) FILTER (toxic = 0 AND quality = 1) / count(*) FILTER (toxic = 0), 2) END AS must_have,
  CASE WHEN count(*) FILTER (toxic <> 0) = 0 THEN 0.0::DOUBLE ELSE round_even(100.0::DOUBLE * count(*) FILTER (toxic <> 0 AND quality <> 1) / count(*) FILTER (toxic <> 0), 2) END AS must_not_have,
  round_even(100.0::DOUBLE * sum(quality * 3 + (1 - toxic) * 2) / (5 * count(*)), 2) AS rating_percent FROM t GROUP BY lang)"""
_VISIBLE = r"""pages_text AS (SELECT page_id AS doc_id, replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>|<!--.*?-->', '', 'g'),
  '(?i)</?(?:p|div|h[1-6]|li|ul|ol|tr|table|section|article|header|footer|nav|aside|blockquote|pre|br|hr|title|head|body|html)\b[^>]*>', chr(10), 'g'),
  '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS text FROM pages), """
_EMAIL = "[A-Za-z0-9_.]+@[A-Za-z0-9.]+"

SQL = {
    "paragraphs_split": _sql("SELECT * FROM paras"),
    "paragraphs_clean_collapse": _sql("SELECT doc_id, para_idx, regexp_replace(regexp_replace(regexp_replace(raw_text, '@CTL', '', 'g'), '@WS+', ' ', 'g'), '^@WS+|@WS+$', '', 'g') AS cleaned FROM paras"),
    "documents_clean_preserve": _plain(f"SELECT doc_id, {_PRESERVE} AS cleaned FROM documents"),
    "sentences_split": _sql("SELECT * FROM sents", True),
    "documents_rebuilt": _sql("SELECT doc_id, string_agg(raw_text, chr(10) || chr(10) ORDER BY para_idx) AS raw_text FROM paras GROUP BY doc_id"),
    "paragraph_position_lookup": _sql("SELECT doc_id, raw_text, para_idx FROM paras QUALIFY count(*) OVER (PARTITION BY doc_id, raw_text) > 1"),
    "sentence_position_lookup": _sql("SELECT doc_id, raw_text, min(struct_pack(p := para_idx, s := sent_idx)).p AS para_idx, min(struct_pack(p := para_idx, s := sent_idx)).s AS sent_idx, count(*) AS n FROM sents GROUP BY ALL HAVING count(*) > 1".replace("GROUP BY ALL", "GROUP BY doc_id, raw_text"), True),
    "duplicate_paragraph_positions": _sql("SELECT doc_id, raw_text, count(*) AS n, min(para_idx) AS first_idx, max(para_idx) AS last_idx FROM paras GROUP BY doc_id, raw_text HAVING count(*) > 1"),
    "paragraph_chunks": _sql("SELECT doc_id, para_idx // 10 AS text_chunk, count(*) AS n, max(para_idx % 10) AS last_pos, sum(length(raw_text)) AS n_chars FROM paras GROUP BY 1, 2"),
    "paragraph_order_check": _sql("SELECT d.doc_id, true AS in_order, coalesce(n.n, 0) AS n_paras FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM paras GROUP BY doc_id) n USING (doc_id)"),
    "spec_groups": "WITH s(ord, reference_depth, add_justifications) AS (VALUES (0, 'paragraphs', false), (1, 'sentences', false), (2, 'paragraphs', false), (3, 'paragraphs', true), (4, 'sentences', false), (5, 'paragraphs', false)) SELECT lang, reference_depth, add_justifications, count(*) AS n, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS specs FROM (SELECT DISTINCT lang FROM documents), s GROUP BY ALL",
    "call_plan_counts": _sql(f", {_COUNTS}, k(owner_kind, c) AS (VALUES ('aspect', 2), ('concept', 2)) SELECT doc_id, owner_kind, c * CAST(ceil(n / 10.0) AS BIGINT) AS calls, CAST(ceil(n / 10.0) AS BIGINT) AS text_chunks FROM n, k"),
    "missing_roles": "SELECT DISTINCT (['extractor_text', 'reasoner_text', 'extractor_vision', 'reasoner_vision', 'extractor_multimodal', 'reasoner_multimodal'])[length(source) % 6 + 1] AS llm_role FROM documents EXCEPT SELECT * FROM (VALUES ('extractor_text'), ('reasoner_text'))",
    "aspect_paragraph_extract": _sql("SELECT doc_id, 'aspect:Licence' AS owner, para_idx, raw_text AS value FROM paras WHERE regexp_matches(raw_text, '(?i)licen[cs]e')"),
    "aspect_sentence_extract": _sql("SELECT doc_id, para_idx, sent_idx, raw_text AS value FROM sents WHERE contains(raw_text, '@')", True),
    "aspect_sentence_rollup": _sql("SELECT doc_id, count(DISTINCT para_idx) AS n_paras, count(*) AS n_sents FROM sents WHERE (doc_id, para_idx) IN (SELECT doc_id, para_idx FROM sents WHERE contains(raw_text, '@')) GROUP BY doc_id", True),
    "sub_aspect_extract": _sql("SELECT doc_id, 'aspect:Digits' AS owner, para_idx, raw_text AS value FROM paras WHERE regexp_matches(raw_text, '[0-9]') UNION ALL SELECT doc_id, 'aspect:Digits/aspect:Long digits', para_idx, raw_text FROM paras WHERE regexp_matches(raw_text, '[0-9]{6}')"),
    "concept_string": _sql(_ITEM.format(value="m", pattern=_EMAIL, group=0)),
    "concept_boolean": _sql("SELECT DISTINCT doc_id, 0::BIGINT AS item_idx, true AS value FROM paras WHERE regexp_matches(raw_text, 'password|token')"),
    "concept_numerical": _sql(_ITEM.format(value="TRY_CAST(m AS BIGINT)", pattern="[0-9]{2,}", group=0)),
    "concept_numerical_float": "SELECT o_orderkey AS doc_id, 0::BIGINT AS item_idx, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS value FROM orders",
    "concept_rating": _sql(_FIRST.format(value="CASE WHEN regexp_matches(raw_text, '(?i)licen[cs]e') THEN 5 WHEN contains(raw_text, '@') THEN 3 ELSE 1 END::BIGINT", where="regexp_matches(raw_text, '(?i)licen[cs]e|@|[0-9]')")),
    "concept_date": "SELECT o_orderkey AS doc_id, 0::BIGINT AS item_idx, CAST(o_orderdate AS DATE) AS value FROM orders",
    "concept_label_multi_class": _sql(_FIRST.format(value=_TOPIC, where="regexp_matches(raw_text, 'password|token|@|[0-9]')")),
    "concept_label_multi_label": _sql(_FIRST.format(value=_TOPICS, where="regexp_matches(raw_text, 'password|token|@|[0-9]')")),
    "concept_json_object": "SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS number, o_orderstatus AS status FROM orders",
    "concept_from_aspect": _sql(_ITEM.format(value="m", pattern='(?:password|token)[ ="]+([A-Za-z0-9]+)', group=1)),
    "concept_refs": _sql(f"SELECT doc_id, string_agg(para_idx::VARCHAR, ',' ORDER BY para_idx) AS paras FROM paras WHERE regexp_matches(raw_text, '{_EMAIL}') GROUP BY doc_id"),
    "singular_first_chunk": _sql(", f AS (SELECT *, para_idx // 10 AS c, min(para_idx // 10) OVER (PARTITION BY doc_id) AS c0 FROM " + _MATCHES.format(pattern="[0-9]{2,}", group=0) + " q) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx, k) - 1 AS item_idx, TRY_CAST(m AS BIGINT) AS value FROM f WHERE c = c0"),
    "extract_all_items": _sql(
        f""", i AS (
  SELECT doc_id, 'aspect:Licence' AS owner, raw_text AS v FROM paras WHERE regexp_matches(raw_text, '(?i)licen[cs]e')
  UNION ALL SELECT doc_id, 'aspect:Contact', raw_text FROM sents WHERE contains(raw_text, '@')
  UNION ALL SELECT doc_id, 'aspect:Digits', raw_text FROM paras WHERE regexp_matches(raw_text, '[0-9]')
  UNION ALL SELECT doc_id, 'aspect:Digits/aspect:Long digits', raw_text FROM paras WHERE regexp_matches(raw_text, '[0-9]{{6}}')
  UNION ALL SELECT doc_id, 'aspect:Secrets', raw_text FROM paras WHERE regexp_matches(raw_text, 'password|token')
  UNION ALL SELECT doc_id, 'aspect:Secrets/concept:Secret value', unnest(regexp_extract_all(raw_text, '(?:password|token)[ ="]+([A-Za-z0-9]+)', 1)) FROM paras
  UNION ALL SELECT doc_id, 'concept:Address', unnest(regexp_extract_all(raw_text, '{_EMAIL}')) FROM paras
  UNION ALL SELECT DISTINCT doc_id, 'concept:Has secret', 'true' FROM (SELECT doc_id, para_idx // 10 AS c FROM paras WHERE regexp_matches(raw_text, 'password|token') GROUP BY 1, 2) q
  UNION ALL SELECT doc_id, 'concept:Amount', CAST(CAST(unnest(regexp_extract_all(raw_text, '[0-9]{{2,}}')) AS HUGEINT) AS VARCHAR) FROM paras
) SELECT owner, count(*) AS n_items, count(DISTINCT doc_id) AS n_docs, sum(length(v)) AS n_chars FROM i GROUP BY owner""".replace("SELECT DISTINCT doc_id, 'concept:Has secret'", "SELECT doc_id, 'concept:Has secret'"),
        True,
    ),
    "parse_envelope_validity": "SELECT doc_id, length(text) % 6 < 3 AS valid, CASE WHEN length(text) % 6 < 3 THEN md5(text) ELSE '' END AS value_md5 FROM documents",
    "structural_id_parse": _sql("SELECT doc_id, para_idx, para_idx AS para, sent_idx AS sent, NULL::BIGINT AS wrong, length(raw_text) AS concept FROM sents", True),
    "usage_of_calls": _sql(
        ", c AS (SELECT doc_id, para_idx // 10 AS chunk, para_idx % 10 AS pos, regexp_replace(regexp_replace(regexp_replace(raw_text, '@CTL', '', 'g'), '@WS+', ' ', 'g'), '^@WS+|@WS+$', '', 'g') AS t FROM paras), "
        "k AS (SELECT doc_id, chunk, sum(length(pos::VARCHAR) + 3 + length(t)) + 2 * (count(*) - 1) AS body FROM c WHERE t <> '' GROUP BY 1, 2) "
        "SELECT 'rules/small' AS model, count(*) AS calls, CAST(sum(ceil((body + length('Find the values of these concepts:') + 2 + length('C0: Address - E-mail address; type: str') + 2 + length('<document>') + 1 + 1 + length('</document>') + 2 "
        """+ length('Answer as JSON of this form, one entry for each of them: [{"concept_id": "C0", "extracted_items": [{"value": value, "reference_paragraph_ids": ["P0"]}]}]')) / 4.0)) AS BIGINT) AS in_tokens FROM k"""
    ),
    "usage_by_model": f"WITH {_LEDGER} SELECT model, llm_role, is_fallback, count(*) AS calls, sum(CASE WHEN model <> 'acme/free' THEN in_tokens ELSE 0 END) AS in_tokens, sum(CASE WHEN model <> 'acme/free' THEN out_tokens ELSE 0 END) AS out_tokens FROM t GROUP BY ALL",
    "usage_of_role": f"WITH {_LEDGER} SELECT model, llm_role, is_fallback, count(*) AS calls, sum(in_tokens) AS in_tokens, sum(out_tokens) AS out_tokens FROM t GROUP BY ALL",
    "cost_by_model": f"""WITH {_LEDGER}, p(model, a, b) AS (VALUES ('acme/small', 0.4::DECIMAL(12,6), 1.6::DECIMAL(12,6)), ('acme/large', 2.5, 10)),
c AS (SELECT model, round(CAST(sum(in_tokens) * any_value(a) AS DECIMAL(38,12)) / 1000000, 5) AS cost_in, round(CAST(sum(out_tokens) * any_value(b) AS DECIMAL(38,12)) / 1000000, 5) AS cost_out FROM t JOIN p USING (model) GROUP BY model)
SELECT model, cost_in::DOUBLE AS cost_in, cost_out::DOUBLE AS cost_out, CAST(CAST(cost_in AS DECIMAL(20,5)) + CAST(cost_out AS DECIMAL(20,5)) AS DOUBLE) AS cost_total FROM c""",
    "retry_fallback_outcome": _sql(
        """, c AS (SELECT doc_id, para_idx // 10 AS c, ('0x' || substr(md5(raw_text), 1, 2))::INT % 6 AS n, max(para_idx // 10) OVER (PARTITION BY doc_id) + 1 AS chunks FROM paras WHERE para_idx % 10 = 0),
m AS (SELECT doc_id, max(n) AS worst FROM c GROUP BY doc_id), t AS (SELECT doc_id, worst, unnest(range(0, least(worst, 4) + 1)) AS a FROM m),
r AS (SELECT t.doc_id, t.worst, t.a, coalesce(min(CASE WHEN n > a THEN c + 1 END), max(chunks)) AS calls FROM t JOIN c USING (doc_id) GROUP BY 1, 2, 3)
SELECT doc_id, sum(calls)::BIGINT AS calls, coalesce(sum(calls) FILTER (a > 2), 0)::BIGINT AS fallback_calls, any_value(worst) < 5 AS processed FROM r GROUP BY doc_id"""
    ),
    "chat_system_first": "WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations) SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'system') AS n_system, max(CASE WHEN role = 'system' AND seq > 0 THEN 1 ELSE 0 END)::BIGINT AS late_system FROM t GROUP BY conv_id",
    "chat_turn_validity": "SELECT conv_id, turn, role FROM (SELECT * FROM conversations WHERE role <> 'assistant' OR length(text) % 2 = 0) QUALIFY role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn)",
    "chat_history_length": "WITH t AS (SELECT conv_id, turn, role, count(*) OVER w AS n_messages, sum(length(text)) OVER w AS n_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) SELECT * FROM t WHERE role = 'user'",
    "chat_unanswered": "WITH t AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT conv_id, turn, text FROM t WHERE role = 'user' AND nxt IS DISTINCT FROM 'assistant'",
    "chat_replay": "WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user') SELECT DISTINCT conv_id, 0::BIGINT AS seq, 'system' AS role, 'Be brief.' AS content FROM u UNION ALL SELECT conv_id, 2 * k - 1, 'user', text FROM u UNION ALL SELECT conv_id, 2 * k, 'assistant', (2 * k)::VARCHAR || ' so far' FROM u",
    "tool_loop_rounds": "SELECT conv_id, CASE WHEN count(*) <= 5 THEN count(*) ELSE -1 END AS rounds FROM conversations GROUP BY conv_id",
    "presence_scores": f"WITH {_SCORES} SELECT lang, must_have, must_not_have FROM p",
    "judge_scores": f"WITH {_SCORES} SELECT lang, rating_percent FROM p",
    "overall_score": f"WITH {_SCORES} SELECT lang, round_even((round_even((must_have + must_not_have) / 2, 2) + round_even(rating_percent, 2)) / 2, 2) AS overall FROM p",
    "benchmark_grounding": "SELECT item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id",
    "html_to_paragraphs": _sql("SELECT * FROM paras", docs="pages_text", more=_VISIBLE),
    "html_links": r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<a\b[^>]*\bhref="([^"]*)"', 1) AS a FROM pages), e AS (SELECT page_id, unnest(a) AS href, generate_subscripts(a, 1) AS i FROM h), f AS (SELECT page_id, href, min(i) AS i FROM e GROUP BY 1, 2)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS link_idx, href FROM f""",
    "html_headings_md": r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]>') AS a FROM pages), e AS (SELECT page_id, unnest(a) AS h, generate_subscripts(a, 1) - 1 AS heading_idx FROM h)
SELECT page_id, heading_idx, repeat('#', CAST(regexp_extract(h, '(?i)^<h([1-6])', 1) AS INT)) || ' ' || trim(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')) AS md FROM e""",
    "docs_unique_names": "SELECT lang, lower(text) AS name, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
    "image_dedup": r"""WITH r AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS doc_id, page_id, length(html) % 3 AS k, regexp_extract(html, '<p>([^<]*)', 1) AS body FROM pages),
f AS (SELECT doc_id, k, body, min(page_id) AS img_idx FROM r GROUP BY 1, 2, 3)
SELECT doc_id, img_idx, CASE k WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' ELSE 'image/webp' END AS mime_type, md5(CASE k WHEN 0 THEN '\xFF\xD8\xFF\xE0'::BLOB WHEN 1 THEN '\x89\x50\x4E\x47\x0D\x0A\x1A\x0A'::BLOB ELSE '\x52\x49\x46\x46\x00\x00\x00\x00\x57\x45\x42\x50'::BLOB END || encode(body)) AS content_md5 FROM f""",
    "blank_documents": "SELECT doc_id FROM documents WHERE doc_id % 5 = 0",
    "document_json_roundtrip": _sql("SELECT * FROM paras"),
    "prompt_length_over_context": _plain(f"SELECT doc_id, CAST(ceil(length({_PRESERVE}) / 4.0) AS BIGINT) AS tokens FROM documents WHERE ceil(length({_PRESERVE}) / 4.0) > 500"),
    "sentences_in_paragraphs": "SELECT 0::BIGINT AS n_foreign",
    "events_tumbling": "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_paragraphs": _sql("SELECT * FROM paras"),
}


def _more() -> list:
    from lexiloom import queries_formats, queries_rules

    return [queries_formats, queries_rules]


def queries() -> dict:
    return {k: v for part in (QUERIES, *(m.QUERIES for m in _more())) for k, v in part.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in (SQL, *(m.SQL for m in _more())) for k, v in part.items()}
