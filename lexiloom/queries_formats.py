"""Registered queries of file formats and prompts: Word files made of the documents and read back, pictures, prompts and messages of calls."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import engine, extract, quality, runtime, score, segment
from lexiloom.plans import prompts
from lexiloom.plans import specs as S
from lexiloom.queries import ADDRESS, BACKENDS, CHUNK, CONTACT, DIGITS, LICENCE, MODELS, _items, _plain, _sql, docs, long
from lexiloom.sources import docx, images
from lexiloom.sources import docx_write as W

NUMBERED = ("decimal", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "ordinal", "cardinalText", "ordinalText", "hex", "chicago", "japaneseCounting", "aiueo", "iroha", "decimalZero", "hindiNumbers", "thaiNumbers")


def _block(i: int, text: str) -> str:
    """A paragraph in one of eight forms, by its number."""
    k = i % 8
    if k == 7:
        return W.paragraph(W.link(text, f"l{i}"))
    marks = {1: ("bold",), 2: ("italic",), 6: ("strike", "underline")}.get(k, ())
    return W.paragraph(W.run(text, *marks), item={3: (1, 0), 4: (1, 1), 5: (2, 0)}.get(k))


def word_file(doc_id: int, lang: str, source: str, n_chars: int, paras: list[str]) -> bytes:
    """A document as a Word file with something of every part that such files have."""
    cell = lambda t: W.paragraph(W.run(t))
    body = W.paragraph(W.run(f"Document {doc_id}"), style="H1") + "".join(_block(i, p) for i, p in enumerate(paras))
    body += W.table([[cell("doc_id"), cell("lang")], [cell(str(doc_id)), cell(lang)]])
    body += W.paragraph(W.run("Length"), W.note("footnote", 1), W.text_box(cell(f"Boxed {doc_id}")), W.deleted("taken out"))
    body += W.paragraph(W.run("Page "), W.page_field("7")) + W.paragraph(W.run("Remark"), W.note("comment", 1))
    pictures = (("a.png", b"p%d" % (doc_id % 7)), ("b.png", b"p%d" % (doc_id % 7)), ("c.jpg", lang.encode()))
    return W.package(
        body, (cell(f"Source: {source}"),), (cell(f"End of {doc_id}"),), {1: cell(f"{n_chars} characters")}, ((1, source, "2024-01-01", cell(f"Checked in {lang}")),),
        {f"l{i}": f"https://example.org/{doc_id}/{i}" for i in range(7, len(paras), 8)}, {"H1": "heading 1"}, {1: ("decimal", "lowerLetter"), 2: ("bullet",)}, pictures,
    )


def word_files(spark, sf_dir) -> DataFrame:
    """(path, content): every document as a Word file."""
    runtime.prepare(spark)
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def work(batches):
        for batch in batches:
            rows = [(f"{r['doc_id']}.docx", word_file(**r)) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)

    rows = segment.with_paragraphs(docs(spark, sf_dir)).selectExpr("doc_id", "coalesce(lang, '') AS lang", "coalesce(source, '') AS source", "coalesce(n_chars, 0) AS n_chars", "paras")
    return rows.mapInArrow(work, "path string, content binary")


def _word_rows(spark, sf_dir, options: docx.Options | None = None) -> DataFrame:
    found = docx.converted(word_files(spark, sf_dir), options)
    return found.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), long("para_idx"), "kind", "raw_text", "md_text", F.col("additional_context").alias("context"), "error")


def docx_paragraphs(spark, sf_dir) -> DataFrame:
    """The documents' own paragraphs, with headings, lists, marks and links as Markdown and as context."""
    rows = _word_rows(spark, sf_dir).where("kind = 'body' AND para_idx > 0 AND raw_text NOT IN ('Page') AND NOT raw_text RLIKE '^(Length\\\\[Footnote 1\\\\]|Remark\\\\[Comment 1\\\\]|Boxed [0-9]+)$'")
    return rows.select("doc_id", "para_idx", "raw_text", "md_text", "context", F.coalesce(T.metadata_field(F.col("context"), "List ID"), F.lit("")).alias("list_id"))


def docx_marks(spark, sf_dir) -> DataFrame:
    """Notes' references, text boxes (once), page fields and tracked deletions (not at all)."""
    rows = _word_rows(spark, sf_dir).where("kind = 'body' AND raw_text RLIKE '^(Length.*|Remark.*|Boxed [0-9]+|Page.*)$' AND context NOT LIKE '%List%' AND md_text = raw_text")
    return rows.where("raw_text RLIKE 'Footnote 1|Comment 1|^Boxed|^Page$'").select("doc_id", "raw_text", "context")


def docx_errors(spark, sf_dir) -> DataFrame:
    """Texts that are no packages, and packages whose parts are missing or no XML: a row with the error each."""
    import io
    import zipfile

    @F.udf("binary")
    def content(n: int, text: str) -> bytes:
        if n % 3 == 0:
            return (text or "").encode()
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("word/document.xml" if n % 3 == 1 else "word/other.xml", "<broken")
        return out.getvalue()

    rows = docs(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), content(F.length("text"), F.col("text")).alias("content"))
    return docx.converted(rows).select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.regexp_extract("error", "^([A-Za-z]+)", 1).alias("error"), F.col("para_idx").isNull().alias("alone"))


def docx_images(spark, sf_dir) -> DataFrame:
    found = docx.pictures(word_files(spark, sf_dir))
    return found.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), long("img_idx"), "mime_type", F.unbase64("base64").cast("string").alias("content"))


def docx_documents(spark, sf_dir) -> DataFrame:
    """Whole files as documents: texts, Markdown, paragraphs and pictures."""
    found = docx.documents(word_files(spark, sf_dir))
    return found.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.md5("raw_text").alias("text_md5"), F.md5("md_text").alias("md_md5"), F.size("paras").cast("long").alias("n_paras"), F.size("images").cast("long").alias("n_images"))


def _from_word(spark, sf_dir, options: docx.Options) -> DataFrame:
    found = docx.documents(word_files(spark, sf_dir), options)
    return found.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id"), F.col("raw_text").alias("text"), "paras", "md_paras")


def word_items(spark, sf_dir) -> DataFrame:
    """An aspect's items from Word files, by their paragraphs."""
    items = _items(_from_word(spark, sf_dir, docx.Options()), (LICENCE,), paragraphs_per_call=CHUNK)
    return items.select("doc_id", F.col("ref_paras")[0].cast("long").alias("para_idx"), F.col("v_str").alias("value"))


def word_prompts(spark, sf_dir) -> DataFrame:
    """Prompts over Word files show their Markdown."""
    return prompts_of(_ledger(spark, sf_dir, (LICENCE,), frame=_from_word(spark, sf_dir, docx.Options(tables=False)), paragraphs_per_call=CHUNK))


def docx_whole_texts(spark, sf_dir) -> DataFrame:
    """Plain text of the rows of a file, joined; and without tables, notes, headers and the like, by options."""
    rows = docx.converted(word_files(spark, sf_dir))
    bare = docx.converted(word_files(spark, sf_dir), docx.Options(tables=False, comments=False, footnotes=False, headers=False, footers=False, textboxes=False, links=False, inline=False))
    ident = F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("doc_id")
    whole = docx.whole_texts(rows, False).select(ident, F.md5("text").alias("text_md5"))
    return whole.join(docx.whole_texts(bare, False).select(ident, F.md5("text").alias("bare_md5")), "doc_id")


def docx_list_formats(spark, sf_dir) -> DataFrame:
    """For every nation a list in one of the formats: numbered or not."""
    runtime.prepare(spark)

    @F.udf("binary")
    def content(name: str, n: int) -> bytes:
        return W.package(W.paragraph(W.run(name), item=(1, 0)), lists={1: ((*NUMBERED, "bullet", "none")[n % 18],)})

    rows = runtime.table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), content("n_name", "n_nationkey").alias("content"))
    return docx.converted(rows).select(F.col("raw_text").alias("name"), T.metadata_field(F.col("additional_context"), "List Type").alias("list_type"), F.when(F.startswith("md_text", F.lit("1. ")), "1.").otherwise("-").alias("mark"))


def markdown_plain(spark, sf_dir) -> DataFrame:
    """Names of parts under all markers, and without them."""
    p = runtime.table(spark, sf_dir, "part")
    md = F.concat(F.lit("**"), "p_name", F.lit("** [***"), "p_brand", F.lit("***](http://x/(1) ~~"), "p_type", F.lit("~~ <u>*"), F.col("p_size").cast("string"), F.lit("*</u>"))
    return p.select("p_partkey", T.without_markdown(md).alias("plain"))


# ---- prompts


def _ledger(spark, sf_dir, aspects=(), concepts=(), models=MODELS, frame=None, **settings) -> DataFrame:
    got = extract.extract(docs(spark, sf_dir) if frame is None else frame, S.Pipeline(aspects, concepts), models, {m.role: BACKENDS["extractor_text"] for m in models}, engine.Settings(**settings))
    return got.ledger


def prompts_of(ledger: DataFrame) -> DataFrame:
    return ledger.select("doc_id", long("call_idx"), F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("long").alias("n_chars"))


def prompt_messages(spark, sf_dir) -> DataFrame:
    """System and user message of a call on each whole document, in English or in the document's language."""
    runtime.prepare(spark)

    @F.pandas_udf("struct<system:string,roles:string,user_md5:string>")
    def made(text: pd.Series, lang: pd.Series) -> pd.DataFrame:
        out = []
        for t, where in zip(text, lang):
            spec = S.StringConcept("Theme", "What it is about")
            prompt = prompts.render("concept", [spec], {p: getattr(spec, p) for p in engine.PARAMS}, [], [], False, t or "")
            messages = [{"role": "system", "content": prompts.system_message("en" if where == "en" else "adapt")}, prompts.user_message(prompt)]
            out.append((messages[0]["content"], ",".join(m["role"] for m in messages), hashlib.md5(messages[1]["content"].encode()).hexdigest()))
        return pd.DataFrame(out, columns=["system", "roles", "user_md5"])

    return docs(spark, sf_dir).select("doc_id", made("text", "lang").alias("m")).select("doc_id", "m.*")


def _host_images(spark, sf_dir) -> DataFrame:
    """Hosts as documents of pictures only: one a page, in order of page ids."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    picture = F.struct(F.lit("image/png").alias("mime"), F.base64(F.encode(F.concat(F.lit("p"), F.col("page_id").cast("string")), "utf-8")).alias("data"))
    rows = runtime.table(spark, sf_dir, "pages").groupBy(host.alias("host")).agg(F.min("page_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("page_id", picture.alias("i")))).alias("held"))
    return rows.select("doc_id", F.lit(None).cast("string").alias("text"), F.transform("held", lambda x: x["i"]).alias("images"))


def image_calls(spark, sf_dir) -> DataFrame:
    """Documents without text, their pictures three a call of a vision model: calls made."""
    concept = S.BooleanConcept("Seen", "Something is to be seen", llm_role="extractor_vision", rule="never")
    ledger = _ledger(spark, sf_dir, concepts=(concept,), models=[S.Model("rules/eyes", role="extractor_vision")], frame=_host_images(spark, sf_dir), images_per_call=3)
    return ledger.groupBy("doc_id").agg(F.count(F.lit(1)).alias("calls"), F.max("llm_role").alias("llm_role"))


def image_messages(spark, sf_dir) -> DataFrame:
    """User messages with pictures: content parts and their data URLs."""
    runtime.prepare(spark)

    @F.udf("struct<n_parts:long,first_url:string,text:string>")
    def made(pictures):
        parts = prompts.user_message("Look.", [(p["mime"], p["data"]) for p in pictures])["content"]
        return len(parts), parts[1]["image_url"]["url"], parts[0]["text"]

    return _host_images(spark, sf_dir).select("doc_id", made("images").alias("m")).select("doc_id", "m.*")


def labels_prompts(spark, sf_dir) -> DataFrame:
    """Sources of each language as labels of a concept: their text in a prompt, and whether they can be labels at all."""
    runtime.prepare(spark)

    @F.udf("struct<listed:string,valid:boolean>")
    def made(labels):
        try:
            S.LabelConcept("Source", "Where it is from", labels)
            valid = True
        except S.SpecError:
            valid = False
        return prompts.labels_text(labels), valid

    rows = docs(spark, sf_dir).where("source IS NOT NULL").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("labels"))
    return rows.select("lang", made("labels").alias("m")).select("lang", "m.*")


def model_requests(spark, sf_dir) -> DataFrame:
    """A model for each source: the parameters of its requests, and whether its budget of output tokens is allowed."""
    runtime.prepare(spark)

    @F.udf("struct<request:string,allowed:boolean,named:boolean>")
    def made(source: str, n: int):
        model = S.Model(f"acme/{source}", reasoning=n % 2 == 1, max_tokens=n * 100, max_completion_tokens=n * 1000)
        try:
            model.check_output(5000)
            allowed = True
        except S.SpecError:
            allowed = False
        try:
            S.Model(source)
            named = True
        except S.SpecError:
            named = False
        return json.dumps(model.request(), sort_keys=True), allowed, named

    rows = docs(spark, sf_dir).where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    got = rows.select("source", made("source", (F.col("n") % 7 + 1).cast("int")).alias("m")).select("source", "m.*")
    field = lambda name: F.get_json_object("request", f"$.{name}")
    return got.select("source", field("model").alias("model"), field("max_tokens").cast("long").alias("max_tokens"), field("max_completion_tokens").cast("long").alias("max_completion_tokens"), field("temperature").cast("double").alias("temperature"), field("num_retries").cast("long").alias("num_retries"), "allowed", "named")


def structure_prompts(spark, sf_dir) -> DataFrame:
    """A structure of each part's columns as a prompt shows it, and its type expression read back."""
    from lexiloom.functions import structure as Y

    runtime.prepare(spark)

    @F.udf("struct<shown:string,expression:string,same:boolean>")
    def made(brand: str, kind: str, size: int):
        from typing import Literal, Optional

        held = {"size": int, "kind": Optional[Literal[kind, brand, size]], "inner": {"notes": list[str], "count": dict[str, float]}, "rows": [{"ok": bool | None}]}  # noqa: UP045
        text = Y.type_text(Y.to_dict(held))
        return Y.prompt_text(held), text, Y.type_text(Y.type_of(text)) == text

    rows = runtime.table(spark, sf_dir, "part").select("p_partkey", made("p_brand", "p_type", "p_size").alias("m")).select("p_partkey", "m.*")
    return rows.select("p_partkey", F.md5("shown").alias("shown_md5"), "expression", "same")


def judge_blocks(spark, sf_dir) -> DataFrame:
    """Items of an aspect as the numbered lines that a judge reads; documents without any say so."""
    items = _items(docs(spark, sf_dir), (LICENCE,)).select("doc_id", "item_idx", "v_str")
    every = docs(spark, sf_dir).select("doc_id").join(items, "doc_id", "left")
    return score.items_block(every, ["doc_id"], "v_str").select("doc_id", F.md5("block").alias("block_md5"))


def image_rules(spark, sf_dir) -> DataFrame:
    """Pictures that a host's pages hold more than once, by their bytes."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    rows = runtime.table(spark, sf_dir, "pages").select(host.alias("host"), F.base64(F.encode(F.concat(F.lit("p"), (F.length("html") % 5).cast("string")), "utf-8")).alias("base64"))
    return quality.repeated_values(rows, "base64", ["host"], fold_case=False)


def image_types(spark, sf_dir) -> DataFrame:
    """Types of pictures by file name and by content (null where the content is none)."""
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".jpg", ".JPEG", ".webp", ".png", ".bin"))), (F.length("html") % 5 + 1).cast("int")))
    rows = runtime.table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.encode("html", "utf-8").alias("content"))
    return rows.select("page_id", images.mime_of_name(F.col("name")).alias("by_name"), images.mime_of(F.col("content")).isNull().alias("no_picture"))


QUERIES = {
    "docx_paragraphs": docx_paragraphs,
    "docx_tables": lambda s, d: _word_rows(s, d).where("kind = 'table'").select("doc_id", "raw_text", "md_text", "context"),
    "docx_sections": lambda s, d: _word_rows(s, d).where("kind NOT IN ('body', 'table')").select("doc_id", "kind", "raw_text", "md_text", "context"),
    "docx_headings": lambda s, d: _word_rows(s, d).where("context = 'Style: Heading 1'").select("doc_id", "para_idx", "raw_text", "md_text"),
    "docx_marks": docx_marks,
    "docx_errors": docx_errors,
    "docx_images": docx_images,
    "docx_documents": docx_documents,
    "docx_whole_texts": docx_whole_texts,
    "docx_list_formats": docx_list_formats,
    "word_items": word_items,
    "word_prompts": word_prompts,
    "markdown_plain": markdown_plain,
    "prompt_aspects": lambda s, d: prompts_of(_ledger(s, d, (LICENCE, DIGITS), paragraphs_per_call=CHUNK).where("prompt LIKE '%A1: Digits%'")),
    "prompt_aspect_sentences": lambda s, d: prompts_of(_ledger(s, d, (CONTACT,), paragraphs_per_call=CHUNK)),
    "prompt_concepts_with_references": lambda s, d: prompts_of(_ledger(s, d, concepts=(ADDRESS,), paragraphs_per_call=CHUNK)),
    "prompt_whole_documents": lambda s, d: prompts_of(_ledger(s, d, concepts=(S.RatingConcept("Grade", "How telling it is", (1, 5), add_justifications=True, rule={"ratings": {5: "licence"}}),))),
    "prompt_messages": prompt_messages,
    "image_calls": image_calls,
    "image_messages": image_messages,
    "labels_prompts": labels_prompts,
    "model_requests": model_requests,
    "structure_prompts": structure_prompts,
    "judge_blocks": judge_blocks,
    "image_rules": image_rules,
    "image_types": image_types,
}

_CLEAN = "regexp_replace(regexp_replace(regexp_replace({0}, '@CTL', '', 'g'), '@WS+', ' ', 'g'), '^@WS+|@WS+$', '', 'g')"
_WORD = """, f AS (SELECT p.doc_id, p.para_idx + 2 AS para_idx, p.para_idx AS i, p.para_idx % 8 AS k, p.raw_text FROM paras p)"""
_MD = """CASE k WHEN 1 THEN '**' || raw_text || '**' WHEN 2 THEN '*' || raw_text || '*' WHEN 3 THEN (i // 8 + 1)::VARCHAR || '. ' || raw_text WHEN 4 THEN '    1. ' || raw_text
  WHEN 5 THEN '- ' || raw_text WHEN 6 THEN '<u>~~' || raw_text || '~~</u>' WHEN 7 THEN '[' || raw_text || '](https://example.org/' || doc_id || '/' || i || ')' ELSE raw_text END"""
_WHOLE = """, w AS (SELECT d.doc_id, string_agg(f.raw_text, chr(10) || chr(10) ORDER BY i) AS body, string_agg({md}, chr(10) || chr(10) ORDER BY i) AS md, count(f.i) AS n,
  any_value(source) AS source, any_value(lang) AS lang, any_value(n_chars) AS n_chars FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id)"""
_J = " || chr(10) || chr(10) || "
_TEXT = _J.join(["'Source: ' || source", "'Document ' || doc_id || coalesce(chr(10) || chr(10) || body, '')", "'doc_id'", "'lang'", "doc_id::VARCHAR", "lang", "'Length[Footnote 1]'", "'Boxed ' || doc_id", "'Page'", "'Remark[Comment 1]'", "n_chars || ' characters'", "'Checked in ' || lang", "'End of ' || doc_id"])
_TABLE = "'| doc_id' || repeat(' ', greatest(0, length(doc_id::VARCHAR) - 6)) || ' | lang' || repeat(' ', greatest(0, length(lang) - 4)) || ' |' || chr(10) || '| ' || repeat('-', greatest(6, length(doc_id::VARCHAR))) || ' | ' || repeat('-', greatest(4, length(lang))) || ' |' || chr(10) || '| ' || rpad(doc_id::VARCHAR, greatest(6, length(doc_id::VARCHAR))::INT, ' ') || ' | ' || rpad(lang, greatest(4, length(lang))::INT, ' ') || ' |'"
_MDTEXT = _J.join(["'**Header**: Source: ' || source", "'# Document ' || doc_id || coalesce(chr(10) || chr(10) || md, '')", _TABLE, "'Length[Footnote 1]'", "'Boxed ' || doc_id", "'Page'", "'Remark[Comment 1]'", "'**Footnote 1**: ' || n_chars || ' characters'", "'**Comment 1 (by ' || source || ')**: Checked in ' || lang", "'**Footer**: End of ' || doc_id"])
_BARE = _J.join(["'Document ' || doc_id || coalesce(chr(10) || chr(10) || body, '')", "'Length'", "'Page'", "'Remark'"])
_CHUNKS = ", c AS (SELECT doc_id, para_idx // 10 AS chunk, para_idx % 10 AS pos, para_idx, " + _CLEAN.format("raw_text") + " AS t FROM paras)"
_NL = "chr(10)"


def _prompt(head: str, specs: list[str], body: str, shape: str, tail: str = "") -> str:
    lines = [head, "", *specs, "", "<document>"]
    literal = " || ".join(f"'{x}' || {_NL}" for x in lines)
    return f"{literal} || {body} || {_NL} || '</document>' || {_NL} || {_NL} || 'Answer as JSON of this form, one entry for each of them: {shape}'{tail}"


_BODY = "coalesce(string_agg('P' || pos || ': ' || t, chr(10) || chr(10) ORDER BY pos) FILTER (t <> ''), '')"
_ASPECTS, _CONCEPTS = "Find the parts of the document about these aspects:", "Find the values of these concepts:"


def _prompts_sql(expression: str, source: str = "c") -> str:
    return f" SELECT doc_id, chunk AS call_idx, md5(p) AS prompt_md5, length(p) AS n_chars FROM (SELECT doc_id, chunk, {expression} AS p FROM {source} GROUP BY doc_id, chunk) q"


SQL = {
    "docx_paragraphs": _sql(
        _WORD + f""" SELECT doc_id, para_idx, raw_text, {_MD} AS md_text, 'Style: Normal' || CASE k WHEN 3 THEN ', List Type: Numbered, List Level: 0, List Format: Decimal, List ID: 1' WHEN 4 THEN ', List Type: Numbered, List Level: 1, List Format: LowerLetter, List ID: 1'
  WHEN 5 THEN ', List Type: Bullet, List Level: 0, List Format: Bullet, List ID: 2' WHEN 7 THEN ', Link URL: https://example.org/' || doc_id || '/' || i ELSE '' END AS context, CASE k WHEN 3 THEN '1' WHEN 4 THEN '1' WHEN 5 THEN '2' ELSE '' END AS list_id FROM f
UNION ALL SELECT doc_id, 1, 'Document ' || doc_id, '# Document ' || doc_id, 'Style: Heading 1', '' FROM documents"""
    ),
    "docx_tables": f"""SELECT doc_id, unnest(['doc_id', 'lang', doc_id::VARCHAR, lang]) AS raw_text, unnest([{_TABLE}, '', '', '']) AS md_text,
  unnest(['Style: Normal, Table ID: 1, Row: 1, Column: 1, Table Cell', 'Style: Normal, Table ID: 1, Row: 1, Column: 2, Table Cell', 'Style: Normal, Table ID: 1, Row: 2, Column: 1, Table Cell', 'Style: Normal, Table ID: 1, Row: 2, Column: 2, Table Cell']) AS context FROM documents""",
    "docx_sections": """SELECT doc_id, unnest(['header', 'footnote', 'comment', 'footer']) AS kind, unnest(['Source: ' || source, n_chars || ' characters', 'Checked in ' || lang, 'End of ' || doc_id]) AS raw_text,
  unnest(['**Header**: Source: ' || source, '**Footnote 1**: ' || n_chars || ' characters', '**Comment 1 (by ' || source || ')**: Checked in ' || lang, '**Footer**: End of ' || doc_id]) AS md_text,
  unnest(['Style: Normal, Header ID: rheader1', 'Style: Normal, Footnote ID: 1', 'Style: Normal, Comment ID: 1, Author: ' || source || ', Date: 2024-01-01', 'Style: Normal, Footer ID: rfooter1']) AS context FROM documents""",
    "docx_headings": "SELECT doc_id, 1::BIGINT AS para_idx, 'Document ' || doc_id AS raw_text, '# Document ' || doc_id AS md_text FROM documents",
    "docx_marks": "SELECT doc_id, unnest(['Length[Footnote 1]', 'Boxed ' || doc_id, 'Page', 'Remark[Comment 1]']) AS raw_text, unnest(['Style: Normal, Footnote: 1', 'Style: Normal, Text Box', 'Style: Normal', 'Style: Normal, Comment: 1']) AS context FROM documents",
    "docx_errors": "SELECT doc_id, CASE length(text) % 3 WHEN 0 THEN 'DocxFormatError' WHEN 1 THEN 'DocxXmlError' ELSE 'DocxFormatError' END AS error, true AS alone FROM documents",
    "docx_images": "SELECT doc_id, unnest([0, 1])::BIGINT AS img_idx, unnest(['image/png', 'image/jpeg']) AS mime_type, unnest(['p' || (doc_id % 7), lang]) AS content FROM documents",
    "docx_documents": _sql(_WORD + _WHOLE.format(md=_MD) + f" SELECT doc_id, md5({_TEXT}) AS text_md5, md5({_MDTEXT}) AS md_md5, 13 + n AS n_paras, 2::BIGINT AS n_images FROM w"),
    "docx_whole_texts": _sql(_WORD + _WHOLE.format(md=_MD) + f" SELECT doc_id, md5({_TEXT}) AS text_md5, md5({_BARE}) AS bare_md5 FROM w"),
    "word_items": _sql("SELECT doc_id, para_idx + 2 AS para_idx, raw_text AS value FROM paras WHERE regexp_matches(raw_text, '(?i)licen[cs]e')"),
    "word_prompts": _sql(
        _WORD + f""", n AS (SELECT d.doc_id, count(f.i) AS n, any_value(source) AS source, any_value(lang) AS lang, any_value(n_chars) AS n_chars FROM documents d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id),
r AS (SELECT doc_id, 0 AS idx, '**Header**: Source: ' || source AS t FROM documents UNION ALL SELECT doc_id, 1, '# Document ' || doc_id FROM documents UNION ALL SELECT doc_id, para_idx, {_MD} FROM f
  UNION ALL SELECT doc_id, n + 2 + unnest(range(0, 7)), unnest(['Length[Footnote 1]', 'Boxed ' || doc_id, 'Page', 'Remark[Comment 1]', '**Footnote 1**: ' || n_chars || ' characters', '**Comment 1 (by ' || source || ')**: Checked in ' || lang, '**Footer**: End of ' || doc_id]) FROM n),
c AS (SELECT doc_id, idx // 10 AS chunk, idx % 10 AS pos, {_CLEAN.format("t")} AS t FROM r)""" + _prompts_sql(_prompt(_ASPECTS, ["A0: Licence - Licensing terms"], _BODY, '[{"aspect_id": "A0", "paragraph_ids": ["P0"]}]'))
    ),
    "docx_list_formats": "SELECT n_name AS name, CASE WHEN n_nationkey % 18 < 16 THEN 'Numbered' ELSE 'Bullet' END AS list_type, CASE WHEN n_nationkey % 18 < 16 THEN '1.' ELSE '-' END AS mark FROM nation",
    "markdown_plain": "SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_size AS plain FROM part",
    "prompt_aspects": _sql(_CHUNKS + _prompts_sql(_prompt(_ASPECTS, ["A0: Licence - Licensing terms", "A1: Digits - Text with figures"], _BODY, '[{"aspect_id": "A0", "paragraph_ids": ["P0"]}]'))),
    "prompt_aspect_sentences": _sql(
        _CHUNKS + ", z AS (SELECT doc_id, para_idx, string_agg('[P' || (para_idx % 10) || '-S' || sent_idx || '] ' || " + _CLEAN.format("raw_text") + ", ' ' ORDER BY sent_idx) FILTER (" + _CLEAN.format("raw_text") + " <> '') AS s FROM sents GROUP BY 1, 2), e AS (SELECT c.*, coalesce(s, '') AS s FROM c LEFT JOIN z USING (doc_id, para_idx))"
        + _prompts_sql(_prompt(_ASPECTS, ["A0: Contact - How to reach someone"], "coalesce(string_agg('P' || pos || ': ' || s, chr(10) || chr(10) ORDER BY pos) FILTER (t <> ''), '')", '[{"aspect_id": "A0", "paragraphs": [{"paragraph_id": "P0", "sentences": [{"sentence_id": "P0-S0"}]}]}]'), "e"),
        True,
    ),
    "prompt_concepts_with_references": _sql(_CHUNKS + _prompts_sql(_prompt(_CONCEPTS, ["C0: Address - E-mail address; type: str"], _BODY, '[{"concept_id": "C0", "extracted_items": [{"value": value, "reference_paragraph_ids": ["P0"]}]}]'))),
    "prompt_whole_documents": _sql(
        ", x AS (SELECT doc_id, 0::BIGINT AS chunk, any_value("
        + "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '@CTN', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^@WS+|@WS+$', '', 'g')"
        + ") AS t FROM documents JOIN paras USING (doc_id) GROUP BY doc_id)"
        + _prompts_sql(_prompt(_CONCEPTS, ["C0: Grade - How telling it is; type: int; from 1 to 5"], "any_value(t)", '[{"concept_id": "C0", "extracted_items": [{"value": value, "justification": "..."}]}]', f" || {_NL} || 'Justifications are brief, 2 sentences at most.'"), "x")
    ),
    "prompt_messages": _plain(
        "WITH x AS (SELECT doc_id, lang, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '@CTN', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^@WS+|@WS+$', '', 'g') AS t FROM documents) "
        "SELECT doc_id, 'You read documents and return what is asked for as JSON only. ' || CASE lang WHEN 'en' THEN 'Write in English.' ELSE 'Write in the language of the document.' END AS system, 'system,user' AS roles, md5("
        + _prompt(_CONCEPTS, ["C0: Theme - What it is about; type: str"], "t", '[{"concept_id": "C0", "extracted_items": [value]}]')
        + ") AS user_md5 FROM x"
    ),
    "image_calls": "SELECT min(page_id) AS doc_id, CAST(ceil(count(*) / 3.0) AS BIGINT) AS calls, 'extractor_vision' AS llm_role FROM pages GROUP BY regexp_extract(url, '^https?://([^/]+)', 1)",
    "image_messages": "SELECT min(page_id) AS doc_id, count(*) + 1 AS n_parts, 'data:image/png;base64,' || base64(encode('p' || min(page_id))) AS first_url, 'Look.' AS text FROM pages GROUP BY regexp_extract(url, '^https?://([^/]+)', 1)",
    "labels_prompts": """SELECT lang, '[' || string_agg('"' || source || '"', ', ' ORDER BY source) || ']' AS listed, count(*) >= 2 AND count(DISTINCT lower(source)) = count(*) AS valid FROM (SELECT DISTINCT lang, source FROM documents WHERE source IS NOT NULL) q GROUP BY lang""",
    "model_requests": """WITH s AS (SELECT source, count(*) % 7 + 1 AS n FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT source, 'acme/' || source AS model, CASE WHEN n % 2 = 0 THEN n * 100 END AS max_tokens, CASE WHEN n % 2 = 1 THEN n * 1000 END AS max_completion_tokens, CASE WHEN n % 2 = 0 THEN 0.3::DOUBLE END AS temperature, 3::BIGINT AS num_retries,
  CASE WHEN n % 2 = 1 THEN n * 1000 ELSE n * 100 END <= 5000 AS allowed, contains(source, '/') AS named FROM s""",
    "structure_prompts": """WITH l AS (SELECT p_partkey, array_to_string(list_sort(['"' || p_type || '"', '"' || p_brand || '"', p_size::VARCHAR]), ', ') AS m FROM part)
SELECT p_partkey, md5('{' || chr(10) || '  "size": int,' || chr(10) || '  "kind": optional[literal[' || m || ']],' || chr(10) || '  "inner": {' || chr(10) || '    "notes": list[str],' || chr(10) || '    "count": dict[str, float]' || chr(10) || '  },' || chr(10) || '  "rows": [{' || chr(10) || '    "ok": optional[bool]' || chr(10) || '  }, ...]' || chr(10) || '}') AS shown_md5,
  '{size: int, kind: optional[literal[' || m || ']], inner: {notes: list[str], count: dict[str, float]}, rows: list_instance[{ok: optional[bool]}]}' AS expression, true AS same FROM l""",
    "judge_blocks": _sql(", i AS (SELECT doc_id, raw_text, row_number() OVER (PARTITION BY doc_id ORDER BY para_idx) AS n FROM paras WHERE regexp_matches(raw_text, '(?i)licen[cs]e')) SELECT d.doc_id, md5(coalesce(string_agg(i.n || '. ' || i.raw_text, chr(10) ORDER BY i.n), 'No items extracted')) AS block_md5 FROM documents d LEFT JOIN i USING (doc_id) GROUP BY d.doc_id"),
    "image_rules": "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, base64(encode('p' || (length(html) % 5))) AS base64, count(*) AS n FROM pages GROUP BY 1, 2 HAVING count(*) > 1",
    "image_types": "SELECT page_id, CASE length(html) % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' ELSE 'image/png' END AS by_name, true AS no_picture FROM pages",
}

