"""Registered queries of specifications, structures, messages, integrity rules, streams and small helpers, over the tables' own values."""

from __future__ import annotations

import asyncio
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import structure as Y
from lexiloom.functions import text as T
from lexiloom.operators import chat, engine, extract, ledger, quality, runtime, score, segment
from lexiloom.plans import prompts
from lexiloom.plans import specs as S
from lexiloom.queries import ADDRESS, AMOUNT, BACKENDS, CHUNK, CONTACT, HAS_SECRET, LICENCE, MODELS, _document_ledger, _items, _plain, _sql, docs, long, lookup
from lexiloom.sources import serde
from lexiloom.streaming import streams

# ---- specifications


def _paras_of(spark, sf_dir) -> DataFrame:
    return segment.with_paragraphs(docs(spark, sf_dir)).select("doc_id", "paras")


def document_pipelines(spark, sf_dir) -> DataFrame:
    """A pipeline of each document's paragraphs as concepts: refused where two have one name, else changed and asked in all ways."""
    runtime.prepare(spark)

    @F.udf("struct<valid:boolean,n_all:long,n_left:long,n_cleared:long,n_added:long,n_chars:long,n_roles:long,found:boolean>")
    def made(paras):
        role = lambda i: "reasoner_text" if i % 3 == 2 else "extractor_text"
        concepts = [S.StringConcept(p, f"number {i}", llm_role=role(i)) for i, p in enumerate(paras)]
        try:
            pipeline = S.Pipeline(concepts=concepts)
        except S.SpecError:
            return False, 0, 0, 0, 0, 0, 0, False
        left = pipeline.without_concepts(*paras[:1])
        added = left.add_concepts(*concepts[:1])
        try:
            left.get_concept(paras[0])
            found = True
        except S.SpecError:
            found = False
        subset = pipeline.get_concepts(paras[-2:])
        missing = S.missing_roles(pipeline, [S.Model("rules/small")])
        return True, len(pipeline.concepts), len(left.concepts), len(pipeline.without_concepts().concepts), len(added.concepts), sum(len(c.name) for c in subset), len(pipeline.roles) - len(missing), found

    rows = _paras_of(spark, sf_dir).where("size(paras) > 0")
    return rows.select("doc_id", made("paras").alias("m")).select("doc_id", "m.*")


def group_roles(spark, sf_dir) -> DataFrame:
    """Two models for each source, their roles from its numbers: a group only if they differ; a role's model looked up."""
    runtime.prepare(spark)

    @F.udf("struct<valid:boolean,model:string,roles:string>")
    def made(source: str, a: int, b: int):
        models = (S.Model(f"one/{source}", role=S.ROLES[a]), S.Model(f"two/{source}", role=S.ROLES[b]))
        try:
            group = S.Group(models).with_language("adapt")
        except S.SpecError:
            return False, "", ""
        return True, group.by_role(S.ROLES[b]).model, ",".join(group.roles)

    rows = docs(spark, sf_dir).where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("source", made("source", (F.length("source") % 6).cast("int"), (F.col("n") % 6).cast("int")).alias("m")).select("source", "m.*")


def nesting(spark, sf_dir) -> DataFrame:
    """Regions as aspects, nations as their sub-aspects, customers below nations: those that may not stand where they do."""
    t = lambda n: runtime.table(spark, sf_dir, n)
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    specs = (
        t("region").select(key("r", "r_regionkey").alias("aspect_id"), none.alias("parent_id"), F.col("r_name").alias("name"), F.lower("r_name").alias("description"))
        .unionByName(t("nation").select(key("n", "n_nationkey").alias("aspect_id"), key("r", "n_regionkey").alias("parent_id"), F.when(F.col("n_nationkey") % 5 == 0, F.lit("asia")).otherwise(F.col("n_name")).alias("name"), F.col("n_name").alias("description")))
        .unionByName(t("customer").select(key("c", "c_custkey").alias("aspect_id"), key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description")))
    )
    return quality.bad_nesting(specs)


def specs_as_json(spark, sf_dir) -> DataFrame:
    """A pipeline for each nation written as JSON and read again: fields of the JSON, and whether it comes back the same."""
    runtime.prepare(spark)

    @F.udf("struct<json:string,same:boolean,refused:boolean>")
    def made(name: str, region: int):
        spec = S.Pipeline((S.Aspect(name, "ä nation", aspects=(S.Aspect(f"{name} north", "its north"),)),), (S.JsonObjectConcept("Size", "how large", {"area": float, "names": list[str]}), S.RatingConcept("Fame", "how known", (0, region + 1))))
        text = serde.to_json(spec)
        try:
            serde.from_json(text, "Model")
            refused = False
        except S.SpecError:
            refused = True
        return text, serde.to_json(serde.from_json(text, "Pipeline")) == text, refused

    rows = runtime.table(spark, sf_dir, "nation").select("n_nationkey", made("n_name", "n_regionkey").alias("m")).select("n_nationkey", "m.*")
    field = lambda path: F.get_json_object("json", path)
    return rows.select(
        "n_nationkey", field("$.class").alias("class"), field("$.aspects[0].name").alias("aspect"), field("$.aspects[0].description").alias("description"), field("$.aspects[0].aspects[0].name").alias("sub_aspect"),
        field("$.concepts[0].structure").alias("structure"), field("$.concepts[1].rating[1]").cast("long").alias("best"), F.contains("json", F.lit("ä")).alias("plain_letters"), "same", "refused",
    )


def _refused(make) -> bool:
    try:
        make()
    except (S.SpecError, Y.StructureError):
        return True
    return False


def spec_rules(spark, sf_dir) -> DataFrame:
    """For each source, specifications made of its numbers: which of them are refused."""
    runtime.prepare(spark)

    @F.udf("struct<aspect_role:boolean,vision_refs:boolean,scale:boolean,pricing:boolean,fallback:boolean,group:boolean,nested:boolean,example:boolean,deep:boolean>")
    def made(source: str, a: int, b: int):
        role, text = S.ROLES[a], S.StringConcept("c", "d", llm_role=S.ROLES[a])
        model = lambda name, **more: S.Model(f"acme/{name}", **more)
        nested = S.Aspect(source, "one", aspects=(S.Aspect("sub", "two"),))
        return (
            _refused(lambda: S.Aspect("a", "b", concepts=(text,))),
            _refused(lambda: S.StringConcept("c", "d", llm_role=role, add_references=True)),
            _refused(lambda: S.RatingConcept("r", "d", (a, b))),
            _refused(lambda: S.Model(f"{'ollama' if b % 2 else 'acme'}/{source}", auto_pricing=a % 2 == 0, pricing=S.Pricing(1, 2) if a == 2 else None)),
            _refused(lambda: model("x", role=role, fallback=model("y", role=S.ROLES[b], is_fallback=a != 3))),
            _refused(lambda: S.Group((model("x", role=role), model("y", role=S.ROLES[b], output_language="adapt" if b == 1 else "en")))),
            _refused(lambda: S.Aspect("top", "three", aspects=(nested if a % 2 else S.Aspect("TOP" if b % 2 else "low", "four"),))),
            _refused(lambda: S.JsonObjectConcept("j", "d", {"size": int}, examples=({"size": a if b % 2 else source},))),
            S.Pipeline(concepts=(S.StringConcept("c", "d", add_references=a % 2 == 0, reference_depth="sentences" if b % 2 else "paragraphs"),)).needs_sentences,
        )

    rows = docs(spark, sf_dir).where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("source", made("source", (F.length("source") % 6).cast("int"), (F.col("n") % 6).cast("int")).alias("m")).select("source", "m.*")


def templates_rendered(spark, sf_dir) -> DataFrame:
    """A template with a loop and conditions, filled in for each language and its sources."""
    runtime.prepare(spark)
    text = "{# sources #}{{ lang }}:{% for s in sources %} {{ loop.index }}.{{ s.name }}{% if s.n == 1 %}!{% elif s.n != 2 and not loop.last %}+{% else %}-{% endif %}{% endfor %}"
    filled = F.udf(lambda lang, rows: prompts.fill(text, {"lang": lang, "sources": [r.asDict() for r in rows]}), "string")
    counts = docs(spark, sf_dir).where("source IS NOT NULL").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    held = counts.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(F.col("source").alias("name"), "n"))).alias("rows"))
    return held.select("lang", filled("lang", "rows").alias("filled"))


def own_prompts(spark, sf_dir) -> DataFrame:
    """Prompts by a template of the caller's own, ten paragraphs a call."""
    text = "{{ shape }}|{% for s in specs %}{{ s.id }}={{ s.name }}{% endfor %}|{% for p in paragraphs %}{% if not loop.first %};{% endif %}{{ p.number }}:{{ p.text }}{% endfor %}"
    got = extract.extract(docs(spark, sf_dir), S.Pipeline((LICENCE,)), MODELS, BACKENDS, engine.Settings(paragraphs_per_call=CHUNK, render=text))
    return got.ledger.select("doc_id", long("call_idx"), F.md5("prompt").alias("prompt_md5"))


def concurrent_calls(spark, sf_dir) -> DataFrame:
    """Calls made at the same time: one for each concept and each ten paragraphs, in the order of a sequential run."""
    got = extract.extract(docs(spark, sf_dir), S.Pipeline(concepts=(ADDRESS, HAS_SECRET, AMOUNT)), MODELS, BACKENDS, engine.Settings(paragraphs_per_call=CHUNK, concurrent=True), keep_prompts=False)
    calls = got.ledger.groupBy("doc_id").agg(F.count(F.lit(1)).alias("calls"), F.max("call_idx").cast("long").alias("last"))
    items = got.items.where("owner = 'concept:Amount'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_amounts"))
    return calls.join(items, "doc_id", "left").na.fill(0, ["n_amounts"])


def items_replaced(spark, sf_dir) -> DataFrame:
    """Items of two aspects, those of one of them put in place of by a second run with another rule."""
    first = _items(docs(spark, sf_dir), (LICENCE, CONTACT))
    again = _items(docs(spark, sf_dir), (S.Aspect("Licence", "Licensing terms", rule="[0-9]"),))
    return extract.replaced(first, again).groupBy("doc_id", "owner").agg(F.count(F.lit(1)).alias("n"))


# ---- structures and tools


def props_valid(spark, sf_dir) -> DataFrame:
    """Properties of events against a strict structure, as they are and broken in three ways."""
    runtime.prepare(spark)

    @F.udf("struct<valid:boolean,why:string>")
    def checked(props: str, n: int):
        value = json.loads(props)
        value = [value, {**value, "k": str(value["k"])}, {**value, "more": 1}, {}][n]
        why = Y.compile_structure({"k": int, "note": str | None})(value)
        return why is None, why or ""

    rows = runtime.table(spark, sf_dir, "events").select("event_id", checked("props", (F.col("event_id") % 4).cast("int")).alias("m"))
    return rows.select("event_id", "m.*")


def buy(key: int, status: str, price: float = 1.0) -> str:
    """Buy something.

    Args:
        key: which order
        status: its state
    """
    return f"{key}:{status}:{price:.2f}"


async def buy_later(key: int, status: str, price: float = 1.0) -> str:
    """Buy something a little later."""
    await asyncio.sleep(0)
    return buy(key, status, price)


def tool_calls(spark, sf_dir) -> DataFrame:
    """Orders as calls of a tool: arguments that fit are run, by a plain or an asynchronous function; others give an error to the model."""
    runtime.prepare(spark)

    @F.udf("string")
    def called(key: int, status: str, price: float):
        args = {"key": str(key) if status == "P" else key, "status": status, "price": price}
        return chat.run_tool({"name": "buy", "arguments": json.dumps(args)}, {"buy": buy if key % 2 else buy_later})

    rows = runtime.spread(runtime.table(spark, sf_dir, "orders"))
    got = rows.select("o_orderkey", called("o_orderkey", "o_orderstatus", "o_totalprice").alias("answer"))
    return got.select("o_orderkey", F.when(F.contains("answer", F.lit('"error"')), F.lit("error")).otherwise(F.col("answer")).alias("answer"))


def tool_schemas(spark, sf_dir) -> DataFrame:
    """For every column type of the orders table the JSON Schema of a parameter, and a tool's own schema."""
    runtime.prepare(spark)
    rows = spark.createDataFrame(runtime.table(spark, sf_dir, "orders").dtypes, "name string, kind string")

    @F.udf("string")
    def schema(kind: str):
        held = {"bigint": int, "string": str | None, "double": float, "timestamp": list[str], "timestamp_ntz": list[str]}[kind]
        return json.dumps(Y.json_schema(held), sort_keys=True, separators=(",", ":"))

    tool = Y.tool_schema(buy)["function"]
    return rows.select("name", schema("kind").alias("schema"), F.lit(",".join(tool["parameters"]["required"])).alias("required"), F.lit(tool["parameters"]["properties"]["key"]["description"]).alias("note"), F.lit(tool["description"]).alias("summary"))


def docstrings(spark, sf_dir) -> DataFrame:
    """Docstrings made of the parts' columns, taken apart again."""
    runtime.prepare(spark)

    @F.udf("struct<summary:string,first:string,second:string>")
    def made(name: str, brand: str, kind: str, n: int):
        doc = f"Find {name}.\n\n    :param brand: {brand}\n    :param kind: {kind}\n    :return: it\n    " if n % 2 else f"Find {name}.\n\n    Args:\n        brand (str): {brand}\n        kind: {kind}\n\n    Returns:\n        it\n    "
        summary, params = Y.parse_docstring(doc)
        return summary, params.get("brand"), params.get("kind")

    rows = runtime.table(spark, sf_dir, "part").select("p_partkey", made("p_name", "p_brand", "p_type", F.col("p_partkey").cast("int")).alias("m"))
    return rows.select("p_partkey", "m.*")


def parallel_tools(spark, sf_dir) -> DataFrame:
    """A model that asks for as many tools at once as a conversation has turns, and then answers: messages of the session."""
    runtime.prepare(spark)
    turns = runtime.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("n"))

    @F.udf("struct<n_messages:long,answers:string>")
    def made(n: int):
        def complete(messages, allowed):
            if any(m["role"] == "tool" for m in messages):
                return {"content": "done"}
            return {"content": None, "tool_calls": [{"id": f"t{i}", "name": "lookup", "arguments": f'{{"key": {i}}}'} for i in range(n)]}

        session = chat.Session()
        chat.chat(session, "go", complete, S.Model("rules/small", tools=("lookup",)), "Be brief.", {"lookup": lookup}, parallel=True)
        return len(session.messages), ",".join(m["content"] for m in session.messages if m["role"] == "tool")

    return turns.select("conv_id", made("n").alias("m")).select("conv_id", "m.*")


# ---- messages and integrity rules


def _tool_fields(spark, sf_dir) -> DataFrame:
    """Messages with tool fields set by their length: some fit their role, some do not."""
    m = runtime.table(spark, sf_dir, "conversations")
    role = F.when(F.length("text") % 11 == 0, F.lit("tool")).when(F.length("text") % 13 == 0, F.lit("robot")).otherwise(F.col("role"))
    return m.select("conv_id", "turn", "text", role.alias("role"), F.when(F.length("text") % 2 == 0, F.lit("t1")).alias("tool_call_id"), F.when(F.length("text") % 5 == 0, F.array(F.lit("call"))).otherwise(F.array().cast("array<string>")).alias("tool_calls"))


def message_rules(spark, sf_dir) -> DataFrame:
    return quality.bad_messages(_tool_fields(spark, sf_dir)).select("conv_id", "turn", "role")


def message_checks(spark, sf_dir) -> DataFrame:
    """The same by the check that sessions make of each message."""
    runtime.prepare(spark)

    @F.udf("string")
    def why(role, text, call_id, calls):
        return chat.check_message({"role": role, "content": text} | ({"tool_call_id": call_id} if call_id else {}) | ({"tool_calls": calls} if calls else {}))

    return _tool_fields(spark, sf_dir).select("conv_id", "turn", why("role", "text", "tool_call_id", "tool_calls").alias("why")).where("why IS NOT NULL")


def empty_documents(spark, sf_dir) -> DataFrame:
    """Documents that keep neither text (short ones lose it), nor paragraphs (of some languages), nor pictures (of some sources)."""
    d = docs(spark, sf_dir).select("doc_id", F.when(F.length("text") > 1000, F.col("text")).alias("raw_text"), F.when(F.col("lang") == "en", F.array("text")).alias("paragraphs"), F.when(F.length("source") % 2 == 0, F.array("source")).alias("images"))
    return quality.empty_documents(d, ["raw_text", "paragraphs", "images"]).select("doc_id")


def foreign_paragraphs(spark, sf_dir) -> DataFrame:
    """Paragraphs of the documents that do not occur in the same texts without their figures."""
    d = docs(spark, sf_dir)
    changed = d.select("doc_id", F.regexp_replace("text", "[0-9]", "").alias("text"))
    return quality.foreign_paragraphs(changed, segment.paragraphs(d)).select("doc_id", long("para_idx"))


def out_of_order(spark, sf_dir) -> DataFrame:
    """Documents whose first two paragraphs, when exchanged, no longer follow one another in the text."""
    d = segment.with_paragraphs(docs(spark, sf_dir)).where("size(paras) >= 2")
    swapped = d.withColumn("paras", F.array(F.col("paras")[1], F.col("paras")[0]))
    return segment.order_check(swapped).where("NOT in_order").select("doc_id")


def unreferenced(spark, sf_dir) -> DataFrame:
    """Items of an aspect whose paragraph is taken away where its number is odd."""
    items = _items(docs(spark, sf_dir), (LICENCE,)).withColumn("kept", F.filter("ref_paras", lambda p: p % 2 == 0))
    rows = items.select("doc_id", "item_idx", "owner_kind", F.col("kept").alias("ref_paras"))
    return quality.unreferenced(rows).select("doc_id", long("item_idx"))


def names_first(spark, sf_dir) -> DataFrame:
    """Of a source's documents of equal text, the first one."""
    rows = docs(spark, sf_dir).select("source", "doc_id", "text")
    return quality.first_of_each(rows, "text", ["source"], "doc_id").select("source", "doc_id")


def text_predicates(spark, sf_dir) -> DataFrame:
    """Whether a text has line breaks, template tags, and brackets and tags that match."""
    runtime.prepare(spark)

    @F.udf("struct<has_tags:boolean,brackets:boolean,linted:long>")
    def checked(t):
        return prompts.has_tags(t), prompts.brackets_balanced(t), len(prompts.lint("(" + t.replace("(", "").replace(")", "") + ")")) if not set("[]{}<>") & set(t) else -1

    return docs(spark, sf_dir).select("doc_id", T.has_linebreaks(F.col("text")).alias("linebreaks"), checked(F.coalesce("text", F.lit(""))).alias("m")).select("doc_id", "linebreaks", "m.has_tags", "m.brackets", "m.linted")


def page_tags(spark, sf_dir) -> DataFrame:
    """Whether the tags of a page's menu, and of its whole body, match."""
    runtime.prepare(spark)
    balanced = F.udf(prompts.tags_balanced, "boolean")
    menu = F.regexp_extract("html", r"(?s)(<nav>.*</nav>)", 1)
    return runtime.table(spark, sf_dir, "pages").select("page_id", balanced(menu).alias("menu"), balanced(F.concat(menu, F.lit("<b>"))).alias("unclosed"), balanced(F.concat(F.lit("</b>"), menu)).alias("stray"))


# ---- helpers, counters and scores


def small_helpers(spark, sf_dir) -> DataFrame:
    """First match, maps put together and looked up with a default, and numbers taken out of decimals, of each document."""
    paras = segment.with_paragraphs(docs(spark, sf_dir))
    first = F.get(F.filter("paras", lambda p: F.contains(p, F.lit("@"))), F.lit(0))
    held = F.map_concat(F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("?"))), F.create_map(F.lit("chars"), F.length("text").cast("string")))
    wide = F.map_filter(held, lambda k, v: F.length(v) > 2)
    return paras.select("doc_id", F.coalesce(first, F.lit("")).alias("first"), F.coalesce(F.try_element_at(held, F.lit("source")), F.lit("none")).alias("source"), F.array_join(F.array_sort(F.map_keys(wide)), ",").alias("wide"), (F.length("text").cast("decimal(20,3)") / 8).cast("double").alias("eighth"))


def times(spark, sf_dir) -> DataFrame:
    """Times of events as epoch milliseconds, ISO text and back, and days of orders from day-month-year."""
    e = runtime.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    back = F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return e.select("event_id", F.unix_millis("ts").alias("millis"), iso.alias("iso"), (F.unix_millis(back) == F.unix_millis("ts")).alias("same"), F.expr("((unix_millis(ts) % 100000 + 5) DIV 10) / 100.0D").alias("seconds"))


def days(spark, sf_dir) -> DataFrame:
    o = runtime.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", T.strict_date(F.date_format("o_orderdate", "d-M-yyyy")).alias("day"), T.strict_date(F.date_format("o_orderdate", "yyyy-MM-dd")).isNull().alias("refused"), F.date_format(T.strict_date(F.date_format("o_orderdate", "dd-MM-yyyy")), "yyyy-MM-dd").alias("iso"))


def priced_from_table(spark, sf_dir) -> DataFrame:
    """Cost of the documents' calls with prices that models take from a table."""
    table = {"acme/small": S.Pricing("0.40", "1.60"), "large": S.Pricing("2.5", "10")}
    models = [S.Model("acme/small", auto_pricing=True), S.Model("acme/free")]
    rows = _document_ledger(spark, sf_dir).withColumn("is_fallback", F.lit(False))
    got = ledger.cost(rows, ledger.prices(spark, models, table))
    return got.select("model", F.col("cost_in").cast("double").alias("cost_in"), F.col("cost_out").cast("double").alias("cost_out"))


def usage_after_reset(spark, sf_dir) -> DataFrame:
    """Usage once the counters of one role begin anew, merged with what came before."""
    rows = _document_ledger(spark, sf_dir).withColumn("llm_role", F.when(F.col("doc_id") % 2 == 0, "extractor_text").otherwise("reasoner_text"))
    left = ledger.usage(ledger.reset(rows, "extractor_text"))
    return ledger.merged(left, ledger.usage(rows))


def benchmark_scores(spark, sf_dir) -> DataFrame:
    """An extraction scored: licences are wanted in documents of quality, contacts nowhere in toxic ones; a judge rates what was found."""
    items = _items(docs(spark, sf_dir), (LICENCE, CONTACT))
    labelled = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("category")).join(runtime.table(spark, sf_dir, "labels"), "doc_id")
    targets = labelled.select("doc_id", "category", F.lit("aspect:Licence").alias("owner"), (F.col("quality") == 1).alias("wanted"))
    targets = targets.unionByName(labelled.select("doc_id", "category", F.lit("aspect:Contact").alias("owner"), (F.col("toxic") == 0).alias("wanted")))
    replies = targets.select("doc_id", "owner", F.format_string('{"rating": %d, "justification": "x"}', F.col("doc_id") % 7).alias("reply"))
    return score.benchmark(items, targets, replies).select("category", "must_have", "must_not_have", "rating_percent", "overall")


def sentence_positions(spark, sf_dir) -> DataFrame:
    """All positions of the sentences that end in a question mark."""
    sents = segment.sentences(docs(spark, sf_dir))
    wanted = sents.where("raw_text LIKE '%?' OR raw_text LIKE '%!'").select("doc_id", "raw_text").distinct()
    return segment.position_of_sentence(sents, wanted).select("doc_id", "raw_text", long("para_idx"), long("sent_idx"))


def sentences_marked(spark, sf_dir) -> DataFrame:
    """Sentences by a splitter of the caller's own: cut behind semicolons and colons."""
    cut = lambda p: F.filter(F.transform(F.split(p, "[;:]"), T.strip), lambda s: ~T.is_blank(s))
    return segment.sentences(docs(spark, sf_dir), split=cut).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sents"), F.sum(F.length("raw_text")).cast("long").alias("n_chars"))


# ---- streams


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(runtime.table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _complete(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of a stream after all that is there, kept in the shared folder by batch."""
    spark = stream.sparkSession
    at = runtime.shared_dir(spark, "stream")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def events_sliding(spark, sf_dir) -> DataFrame:
    got = _complete(streams.sliding(_stream(spark, sf_dir, "events"), "ts", "event_type", "1 hour", "15 minutes"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def events_sessions(spark, sf_dir) -> DataFrame:
    got = _complete(streams.sessions(_stream(spark, sf_dir, "events"), "ts", "user_id", "30 minutes"))
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


def events_first_seen(spark, sf_dir) -> DataFrame:
    """A stream that brings every event twice, without the repeats."""
    source = _stream(spark, sf_dir, "events")
    at = runtime.shared_dir(spark, "stream")
    streams.run_available(streams.first_seen(source.unionByName(source), "ts", ["event_id"], "10000 days"), f"{at}/out", f"{at}/state")
    return spark.read.parquet(f"{at}/out").select("event_id", "event_type", "value")


def chat_state(spark, sf_dir) -> DataFrame:
    return _complete(streams.chat_state(_stream(spark, sf_dir, "conversations")), "update")


QUERIES = {
    "document_pipelines": document_pipelines,
    "group_roles": group_roles,
    "nesting_rules": nesting,
    "specs_as_json": specs_as_json,
    "spec_rules": spec_rules,
    "templates_rendered": templates_rendered,
    "own_prompts": own_prompts,
    "concurrent_calls": concurrent_calls,
    "items_replaced": items_replaced,
    "props_valid": props_valid,
    "tool_calls": tool_calls,
    "tool_schemas": tool_schemas,
    "docstrings": docstrings,
    "parallel_tools": parallel_tools,
    "message_rules": message_rules,
    "message_checks": message_checks,
    "empty_documents": empty_documents,
    "foreign_paragraphs": foreign_paragraphs,
    "out_of_order": out_of_order,
    "unreferenced_items": unreferenced,
    "first_of_equal_texts": names_first,
    "text_predicates": text_predicates,
    "page_tags": page_tags,
    "small_helpers": small_helpers,
    "times": times,
    "days": days,
    "priced_from_table": priced_from_table,
    "usage_after_reset": usage_after_reset,
    "benchmark_scores": benchmark_scores,
    "sentence_positions": sentence_positions,
    "sentences_own_splitter": sentences_marked,
    "events_sliding": events_sliding,
    "events_sessions": events_sessions,
    "events_first_seen": events_first_seen,
    "chat_state": chat_state,
}

_LEDGER = """l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'acme/small' WHEN 1 THEN 'acme/large' ELSE 'acme/free' END AS model, doc_id % 3 = 1 AS is_fallback,
  CASE WHEN doc_id % 2 = 0 THEN 'extractor_text' ELSE 'reasoner_text' END AS llm_role, CAST(ceil(length(text) / 4.0) AS BIGINT) AS in_tokens FROM documents), t AS (SELECT *, CAST(floor(in_tokens / 7.0) AS BIGINT) AS out_tokens FROM l)"""
_ROLES = "['extractor_text', 'reasoner_text', 'extractor_vision', 'reasoner_vision', 'extractor_multimodal', 'reasoner_multimodal']"
_FIELDS = """SELECT conv_id, turn, text, CASE WHEN length(text) % 11 = 0 THEN 'tool' WHEN length(text) % 13 = 0 THEN 'robot' ELSE role END AS role, length(text) % 2 = 0 AS has_id, length(text) % 5 = 0 AS has_calls FROM conversations"""
_B = "regexp_replace(text, '[^()\\[\\]{}]', '', 'g')"
for _ in range(12):
    _B = f"replace(replace(replace({_B}, '()', ''), '[]', ''), '{{}}', '')"

SQL = {
    "document_pipelines": _sql(
        """, k AS (SELECT doc_id, count(*) AS n, count(DISTINCT lower(raw_text)) = count(*) AS valid, max(para_idx) AS last FROM paras GROUP BY doc_id),
s AS (SELECT doc_id, sum(length(raw_text)) FILTER (para_idx >= last - 1) AS chars FROM paras JOIN k USING (doc_id) GROUP BY doc_id)
SELECT doc_id, valid, CASE WHEN valid THEN n ELSE 0 END AS n_all, CASE WHEN valid THEN n - 1 ELSE 0 END AS n_left, 0::BIGINT AS n_cleared, CASE WHEN valid THEN n ELSE 0 END AS n_added, CASE WHEN valid THEN chars ELSE 0 END::BIGINT AS n_chars,
  CASE WHEN valid THEN 1 ELSE 0 END::BIGINT AS n_roles, false AS found FROM k JOIN s USING (doc_id)"""
    ),
    "group_roles": f"""WITH s AS (SELECT source, length(source) % 6 + 1 AS a, count(*) % 6 + 1 AS b FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT source, a <> b AS valid, CASE WHEN a <> b THEN 'two/' || source ELSE '' END AS model, CASE WHEN a <> b THEN ({_ROLES})[a] || ',' || ({_ROLES})[b] ELSE '' END AS roles FROM s""",
    "nesting_rules": """SELECT 'n' || n_nationkey AS aspect_id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 = 0 AND lower(r_name) = 'asia' UNION ALL SELECT 'c' || c_custkey FROM customer""",
    "specs_as_json": """SELECT n_nationkey, 'Pipeline' AS class, n_name AS aspect, 'ä nation' AS description, n_name || ' north' AS sub_aspect, '{area: float, names: list[str]}' AS structure, CAST(n_regionkey + 1 AS BIGINT) AS best, true AS plain_letters, true AS same, true AS refused FROM nation""",
    "spec_rules": """WITH s AS (SELECT source, length(source) % 6 AS a, count(*) % 6 AS b FROM documents WHERE source IS NOT NULL GROUP BY source)
SELECT source, a >= 2 AS aspect_role, a IN (2, 3) AS vision_refs, NOT (b > a) AS scale, (a = 2) OR (a % 2 = 0 AND b % 2 = 1) AS pricing, a <> b OR a = 3 AS fallback, a = b OR b = 1 AS "group", a % 2 = 1 OR b % 2 = 1 AS nested, b % 2 = 0 AS example, a % 2 = 0 AND b % 2 = 1 AS deep FROM s""",
    "templates_rendered": """WITH c AS (SELECT lang, source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY source, n) AS i, count(*) OVER (PARTITION BY lang) AS k FROM c)
SELECT lang, lang || ':' || string_agg(' ' || i || '.' || source || CASE WHEN n = 1 THEN '!' WHEN n <> 2 AND i < k THEN '+' ELSE '-' END, '' ORDER BY i) AS filled FROM r GROUP BY lang""",
    "own_prompts": _sql(
        ", c AS (SELECT doc_id, para_idx // 10 AS chunk, para_idx % 10 AS pos, regexp_replace(regexp_replace(regexp_replace(raw_text, '@CTL', '', 'g'), '@WS+', ' ', 'g'), '^@WS+|@WS+$', '', 'g') AS t FROM paras) "
        """SELECT doc_id, chunk AS call_idx, md5('[{"aspect_id": "A0", "paragraph_ids": ["P0"]}]|A0=Licence|' || coalesce(string_agg(pos || ':' || t, ';' ORDER BY pos) FILTER (t <> ''), '')) AS prompt_md5 FROM c GROUP BY 1, 2"""
    ),
    "concurrent_calls": _sql(", n AS (SELECT doc_id, CAST(ceil(count(*) / 10.0) AS BIGINT) AS k, sum(len(regexp_extract_all(raw_text, '[0-9]{2,}')))::BIGINT AS n_amounts FROM paras GROUP BY doc_id) SELECT doc_id, 3 * k AS calls, 3 * k - 1 AS last, n_amounts FROM n"),
    "items_replaced": _sql("SELECT doc_id, 'aspect:Licence' AS owner, count(*) AS n FROM paras WHERE regexp_matches(raw_text, '[0-9]') GROUP BY 1 UNION ALL SELECT doc_id, 'aspect:Contact', count(*) FROM sents WHERE contains(raw_text, '@') GROUP BY 1", True),
    "props_valid": """SELECT event_id, event_id % 4 = 0 AS valid, CASE event_id % 4 WHEN 1 THEN '$.k: not int' WHEN 2 THEN '$: unknown [''more'']' WHEN 3 THEN '$.k: missing' ELSE '' END AS why FROM events""",
    "tool_calls": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'error' ELSE o_orderkey || ':' || o_orderstatus || ':' || printf('%.2f', o_totalprice) END AS answer FROM orders",
    "tool_schemas": """SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS name, unnest(['{"type":"integer"}', '{"type":"integer"}', '{"anyOf":[{"type":"string"},{"type":"null"}]}', '{"type":"number"}', '{"items":{"type":"string"},"type":"array"}', '{"anyOf":[{"type":"string"},{"type":"null"}]}']) AS schema, 'key,status' AS required, 'which order' AS note, 'Buy something.' AS summary""",
    "docstrings": "SELECT p_partkey, 'Find ' || p_name || '.' AS summary, p_brand AS first, p_type AS second FROM part",
    "parallel_tools": "WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, n + 4 AS n_messages, array_to_string(list_transform(range(0, n), lambda i: 'entry ' || i), ',') AS answers FROM c",
    "message_rules": f"WITH m AS ({_FIELDS}) SELECT conv_id, turn, role FROM m WHERE role NOT IN ('system', 'user', 'assistant', 'tool') OR (role = 'tool') <> has_id OR (role <> 'assistant' AND has_calls)",
    "message_checks": f"""WITH m AS ({_FIELDS}) SELECT conv_id, turn, CASE WHEN role = 'robot' THEN 'unknown role' WHEN role = 'tool' AND NOT has_id THEN 'a tool message has an id and text' WHEN role <> 'tool' AND has_id THEN 'only tool messages have a tool_call_id' WHEN has_calls AND role <> 'assistant' THEN 'only the assistant calls tools' END AS why FROM m WHERE why IS NOT NULL""",
    "empty_documents": "SELECT doc_id FROM documents WHERE length(text) <= 1000 AND lang <> 'en' AND length(source) % 2 = 1",
    "foreign_paragraphs": _sql("SELECT doc_id, para_idx FROM paras WHERE regexp_matches(raw_text, '[0-9]')"),
    "out_of_order": _sql(", t AS (SELECT doc_id, max(raw_text) FILTER (para_idx = 0) AS a, max(raw_text) FILTER (para_idx = 1) AS b FROM paras GROUP BY doc_id HAVING count(*) >= 2) SELECT doc_id FROM t JOIN documents USING (doc_id) WHERE strpos(substr(text, strpos(text, b) + length(b)), a) = 0"),
    "unreferenced_items": _sql(", i AS (SELECT doc_id, para_idx, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) - 1 AS item_idx FROM paras WHERE regexp_matches(raw_text, '(?i)licen[cs]e')) SELECT doc_id, item_idx FROM i WHERE para_idx % 2 = 1"),
    "first_of_equal_texts": "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, text",
    "text_predicates": f"""SELECT doc_id, regexp_matches(text, '[\\r\\n]') AS linebreaks, regexp_matches(text, '(?s)\\{{\\{{.+?\\}}\\}}|\\{{%.+?%\\}}') AS has_tags, {_B} = '' AS brackets,
  CASE WHEN regexp_matches(text, '[\\[\\]{{}}<>]') THEN -1 ELSE CASE WHEN regexp_matches(text, '\\n\\n\\n') THEN 1 ELSE 0 END END::BIGINT AS linted FROM documents""",
    "page_tags": "SELECT page_id, true AS menu, false AS unclosed, false AS stray FROM pages",
    "small_helpers": _sql("SELECT d.doc_id, coalesce((SELECT arg_min(p.raw_text, p.para_idx) FROM paras p WHERE p.doc_id = d.doc_id AND contains(p.raw_text, '@')), '') AS first, 'none' AS source, CASE WHEN length(text) >= 100 THEN 'chars' ELSE '' END AS wide, length(text) / 8.0 AS eighth FROM documents d"),
    "times": "SELECT event_id, (epoch_us(ts) // 1000) AS millis, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(((epoch_us(ts) // 1000) % 1000)::VARCHAR, 3, '0') || 'Z' AS iso, true AS same, (((epoch_us(ts) // 1000) % 100000 + 5) // 10) / 100.0::DOUBLE AS seconds FROM events",
    "days": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, true AS refused, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders",
    "priced_from_table": """WITH l AS (SELECT CAST(ceil(length(text) / 4.0) AS BIGINT) AS i FROM documents WHERE doc_id % 3 = 0)
SELECT 'acme/small' AS model, round(CAST(sum(i) * 0.4::DECIMAL(12,6) AS DECIMAL(38,12)) / 1000000, 5)::DOUBLE AS cost_in, round(CAST(sum(CAST(floor(i / 7.0) AS BIGINT)) * 1.6::DECIMAL(12,6) AS DECIMAL(38,12)) / 1000000, 5)::DOUBLE AS cost_out FROM l""",
    "usage_after_reset": f"WITH {_LEDGER}, u AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE llm_role <> 'extractor_text') SELECT model, llm_role, is_fallback, count(*) AS calls, sum(in_tokens) AS in_tokens, sum(out_tokens) AS out_tokens FROM u GROUP BY ALL",
    "benchmark_scores": _sql(
        """, f AS (SELECT DISTINCT doc_id, 'L' AS o FROM paras WHERE regexp_matches(raw_text, '(?i)licen[cs]e') UNION ALL SELECT DISTINCT doc_id, 'C' FROM sents WHERE contains(raw_text, '@')),
t AS (SELECT d.doc_id, lang AS category, 'L' AS o, quality = 1 AS wanted FROM documents d JOIN labels USING (doc_id) UNION ALL SELECT d.doc_id, lang, 'C', toxic = 0 FROM documents d JOIN labels USING (doc_id)),
m AS (SELECT t.*, f.doc_id IS NOT NULL AS found, CASE WHEN t.doc_id % 7 <= 5 THEN t.doc_id % 7 ELSE 0 END AS r FROM t LEFT JOIN f USING (doc_id, o)),
s AS (SELECT category, CASE WHEN count(*) FILTER (wanted) = 0 THEN 0.0::DOUBLE ELSE round_even(100.0::DOUBLE * count(*) FILTER (wanted AND found) / count(*) FILTER (wanted), 2) END AS must_have,
  CASE WHEN count(*) FILTER (NOT wanted) = 0 THEN 0.0::DOUBLE ELSE round_even(100.0::DOUBLE * count(*) FILTER (NOT wanted AND NOT found) / count(*) FILTER (NOT wanted), 2) END AS must_not_have,
  CASE WHEN count(*) FILTER (wanted AND found) = 0 THEN 0.0::DOUBLE ELSE round_even(100.0::DOUBLE * sum(r) FILTER (wanted AND found) / (5 * count(*) FILTER (wanted AND found)), 2) END AS rating_percent FROM m GROUP BY category)
SELECT category, must_have, must_not_have, rating_percent, round_even((round_even((must_have + must_not_have) / 2, 2) + round_even(rating_percent, 2)) / 2, 2) AS overall FROM s""",
        True,
    ),
    "sentence_positions": _sql(", w AS (SELECT DISTINCT doc_id, raw_text FROM sents WHERE raw_text LIKE '%?' OR raw_text LIKE '%!') SELECT doc_id, raw_text, para_idx, sent_idx FROM sents JOIN w USING (doc_id, raw_text)", True),
    "sentences_own_splitter": _sql(", s0 AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(raw_text, '[;:]')), '^@WS+|@WS+$', '', 'g') AS s FROM paras) SELECT doc_id, count(*) AS n_sents, sum(length(s))::BIGINT AS n_chars FROM s0 WHERE length(regexp_replace(regexp_replace(s, '@CTL', '', 'g'), '@WS+', '', 'g')) > 0 GROUP BY doc_id"),
    "events_sliding": "SELECT time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * i AS start, event_type, count(*) AS n FROM events, range(0, 4) r(i) GROUP BY 1, 2",
    "events_sessions": """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL '30 minutes' THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
    "events_first_seen": "SELECT event_id, event_type, value FROM events",
    "chat_state": "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_users FROM conversations GROUP BY conv_id",
}
SQL = {k: _plain(v) for k, v in SQL.items()}
