"""Text kernels as Column expressions: splitting, cleaning, markers, ids. No UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode (and Python) has it, and the control and
# zero-width characters that cleaning deletes. Java's \s and Spark's trim are ASCII.
WS = r"[\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028-\u2029\u202F\u205F\u3000]"
CONTROL = r"[\u0000-\u001F\u007F-\u009F\u200B-\u200F\u2028-\u202F\uFEFF]"
CONTROL_BUT_NEWLINE = r"[\u0000-\u0009\u000B-\u001F\u007F-\u009F\u200B-\u200F\u2028-\u202F\uFEFF]"
SENTENCE = r"[^.!?]+[.!?]*"
#: The same classes for RE2 (DuckDB), used by the oracle queries.
WS_RE2 = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}-\x{2029}\x{202F}\x{205F}\x{3000}]"
CONTROL_RE2 = r"[\x{00}-\x{1F}\x{7F}-\x{9F}\x{200B}-\x{200F}\x{2028}-\x{202F}\x{FEFF}]"
CONTROL_BUT_NEWLINE_RE2 = r"[\x{00}-\x{09}\x{0B}-\x{1F}\x{7F}-\x{9F}\x{200B}-\x{200F}\x{2028}-\x{202F}\x{FEFF}]"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def strip_control(text: Column, keep_newlines: bool = False, trim: bool = True) -> Column:
    """Without control, zero-width and direction characters; they are deleted, not spaced."""
    out = F.regexp_replace(text, CONTROL_BUT_NEWLINE if keep_newlines else CONTROL, "")
    return strip(out) if trim else out


def clean_for_prompt(text: Column, keep_linebreaks: bool = True, trim: bool = True) -> Column:
    """Text as prompts carry it: newlines unified, controls deleted, runs of blanks collapsed.

    With ``keep_linebreaks`` single and double newlines stay; without, all white
    space becomes single spaces after controls (newlines among them) are deleted.
    """
    if keep_linebreaks:
        out = F.regexp_replace(text, r"\r\n|\r", "\n")
        out = F.regexp_replace(out, CONTROL_BUT_NEWLINE, "")
        out = F.regexp_replace(out, r"[ \t]+", " ")
        out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    else:
        out = F.regexp_replace(F.regexp_replace(text, CONTROL, ""), f"{WS}+", " ")
    return strip(out) if trim else out


def is_blank(text: Column) -> Column:
    """Nothing is left once controls and white space go."""
    return F.length(F.regexp_replace(F.regexp_replace(text, CONTROL, ""), f"{WS}+", "")) == 0


def has_linebreaks(text: Column) -> Column:
    return text.rlike(r"[\r\n]")


def paragraphs(text: Column) -> Column:
    """Array of stripped paragraphs that are not blank; one ends at any run of line breaks."""
    return F.filter(F.transform(F.split(text, r"[\r\n]+"), strip), lambda p: ~is_blank(p))


def sentences(paragraph: Column) -> Column:
    """Array of stripped, non-blank sentences (rule-based; stands in for a trained segmenter)."""
    return F.filter(F.transform(F.regexp_extract_all(paragraph, F.lit(SENTENCE), 0), strip), lambda s: ~is_blank(s))


#: Where a sentence of any script ends: after a mark with its closing quotes or brackets, behind which white space, an East
#: Asian mark or nothing follows; not after a single capital or a common abbreviation, nor before a small letter.
_BREAK = r"(?<=[.!?\u2026][\"'\u201d\u2019)\]]?)(?<!(?:^|[\s(])(?:[A-Z]|Mr|Mrs|Ms|Dr|Prof|St|No|vs|etc|e\.g|i\.e|cf|approx|bzw|usw|z\.B|d\.h|Nr|p\.ej|Sr|Sra|M|Mme)\.)\s+(?!\p{Ll})|(?<=[\u3002\uff01\uff1f\uff0e][\u201d\u2019\u300d\u300f]?)"


def sentences_by_marks(paragraph: Column) -> Column:
    """Another rule for sentences, for any script: common abbreviations, initials and East Asian marks are known."""
    return F.filter(F.transform(F.split(paragraph, _BREAK), strip), lambda s: ~is_blank(s))


def without_thinking(text: Column) -> Column:
    """A reply without its leading <think> block; null when nothing else is left."""
    out = strip(F.regexp_replace(text, r"^\s*<think>[\s\S]*?</think>", ""))
    return F.when(F.length(out) > 0, out)


def unfenced(text: Column) -> Column:
    """The inside of a ```json fence, or the text itself."""
    inner = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    return F.when(F.length(inner) > 0, inner).otherwise(text)


def whole_json(text: Column) -> Column:
    """VARIANT of a text that is one JSON value and nothing else.

    The parser stops behind the first value; so the text is also parsed as the only
    member of an object and of an array, between which no trailing text gets through.
    """
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one = member.isNotNull() & element.isNotNull() & F.try_variant_get(element, "$[1]", "variant").isNull()
    return F.when(one, F.try_parse_json(text))


def parsed_json(text: Column) -> Column:
    """VARIANT of a reply that is a JSON array or object, fenced or not; else null."""
    value = F.coalesce(whole_json(text), whole_json(unfenced(text)))
    return F.when(F.schema_of_variant(value).rlike("^(ARRAY|OBJECT|STRUCT)"), value)


def structural_index(token: Column, letter: str) -> Column:
    """3 of A3, C3 or P3; of P3-S2 with letter S, 2. Null for anything else."""
    pattern = r"^P+[0-9]+-S([0-9]+)$" if letter == "S" else f"^{letter}+([0-9]+)$"
    return F.expr("int(null)") if letter not in "ACPS" else F.nullif(F.regexp_extract(token, pattern, 1), F.lit("")).try_cast("int")


def without_markdown(text: Column) -> Column:
    """Emphasis, strike-through, link and HTML markers removed; their text stays."""
    out = F.regexp_replace(text, r"(\*\*\*|\*\*|\*|___|__)(.+?)\1", "$2")
    out = F.regexp_replace(out, r"~~(.+?)~~", "$1")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(out, r"<[^>]+>", "")


def metadata_field(context: Column, name: str) -> Column:
    """The value of ``name`` in a 'Name: value, Name: value' line; null if absent."""
    return F.nullif(F.regexp_extract(context, rf"(?:^|, ){name}: ([^,]*)", 1), F.lit(""))


def strict_date(text: Column) -> Column:
    """Day-month-year with one or two digits for day and month, else null."""
    t = strip(text)
    return F.when(t.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), F.try_to_date(t, "d-M-yyyy"))


def percent(part: Column, whole: Column) -> Column:
    """part / whole in percent, two decimals; 0 when there is no whole."""
    return F.when(whole <= 0, F.lit(0.0)).otherwise(F.bround(F.lit(100.0) * part / whole, 2))
