"""Text columns: section cuts, completion cleaning, prompt templates, tokens."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.fixed_values import BEGIN_OF_TEXT, IMPROVED_MARKER, PREAMBLE_OPENINGS, REFUSAL_OPENINGS
from pagemill.functions.draws import coin, draw, normal

# Fixed value: the characters a bare strip() removes, i.e. all Unicode whitespace
# by the str.isspace rule.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

PARAGRAPH_BREAK = "\n\n"
SECTION_METHODS = ("uniform", "gaussian")

# Scripts that put no spaces between words, as ranges of code points: Thai and Lao, Tibetan,
# Myanmar, Khmer, kana, Han with its extensions, and halfwidth kana.
UNSPACED = (
    (0x0E00, 0x0EFF),
    (0x0F00, 0x0FFF),
    (0x1000, 0x109F),
    (0x1780, 0x17FF),
    (0x3040, 0x30FF),
    (0x31F0, 0x31FF),
    (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF),
    (0xF900, 0xFAFF),
    (0xFF66, 0xFF9F),
    (0x20000, 0x3FFFF),
)
_ALONE = "".join(rf"\x{{{low:X}}}-\x{{{high:X}}}" for low, high in UNSPACED)
_SPACE = "".join(rf"\x{{{ord(c):X}}}" for c in WHITESPACE)
# One character of an unspaced script, or a run of letters, marks, digits and "_", or a run of
# whatever else is not white space.
TOKEN_PATTERN = rf"[{_ALONE}]|[\p{{L}}\p{{M}}\p{{N}}_&&[^{_ALONE}]]+|[^\p{{L}}\p{{M}}\p{{N}}_{_SPACE}{_ALONE}]+"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def paragraphs(text: Column) -> Column:
    return F.split(text, PARAGRAPH_BREAK)


def _after_first_paragraph(text: Column) -> Column:
    """Everything after the first blank line; '' when there is none.

    Splitting off at most two pieces leaves the rest as it is, so the text is
    not cut up only to be joined again.
    """
    return F.coalesce(F.get(F.split(text, PARAGRAPH_BREAK, 2), F.lit(1)), F.lit(""))


# --- templates ----------------------------------------------------------------


def render(template: str, **fields: Column) -> Column:
    """Fill a ``{name}`` template with columns, as one ``concat``.

    The template is cut up at planning time; values are never searched for
    placeholders, so braces inside page text stay as they are. A null value is
    spelled ``None``, as string formatting would.
    """
    pieces: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name is not None:
            pieces.append(F.coalesce(fields[name].cast("string"), F.lit("None")))
    return F.concat(*pieces)


# --- section cut ----------------------------------------------------------------


def section_length(n: Column, key: Column, method: str = "uniform", seed: str = "") -> Column:
    """How many of ``n`` paragraphs to keep."""
    if method == "uniform":
        drawn = F.floor(draw(f"{seed}section_n", key) * n) + 1
        return F.when(coin(f"{seed}section_coin", key), drawn).otherwise(n).cast("int")
    if method == "gaussian":
        centre, spread = F.floor(n / 2), F.floor(n / 4)
        value = centre + spread * normal(f"{seed}section_normal", key)
        return F.bround(F.greatest(F.lit(1.0), F.least(n.cast("double"), value)), 0).cast("int")
    raise ValueError(f"section method {method!r} is not one of {SECTION_METHODS}")


def cut_sections(
    df: DataFrame,
    text: str = "webpage",
    key: str = "seq",
    method: str = "uniform",
    seed: str = "",
) -> DataFrame:
    """Replace each text by a drawn prefix of its cleaned paragraphs.

    A text with one paragraph is kept exactly as it is. Only the kept paragraphs
    are cleaned: leading ``#`` first, then surrounding whitespace.
    """
    parts, n = F.col("_parts"), F.size("_parts")
    kept = F.slice(parts, F.lit(1), section_length(n, F.col(key), method, seed))
    cleaned = F.transform(kept, lambda p: strip(F.ltrim(p, F.lit("#"))))
    joined = F.array_join(cleaned, PARAGRAPH_BREAK)
    return (
        df.withColumn("_parts", paragraphs(F.col(text)))
        .withColumn(text, F.when(n == 1, F.col(text)).otherwise(joined))
        .drop("_parts")
    )


# --- completions ----------------------------------------------------------------


def opens_with(text: Column, openings: list[str]) -> Column:
    test = text.startswith(openings[0])
    for opening in openings[1:]:
        test = test | text.startswith(opening)
    return test


def clean_completion(text: Column) -> Column:
    """Drop a "Here is ..." lead-in paragraph, then surrounding double quotes."""
    body = F.when(opens_with(text, PREAMBLE_OPENINGS), _after_first_paragraph(text)).otherwise(text)
    return F.btrim(body, F.lit('"'))


def usable(request: Column, response: Column) -> Column:
    """Both texts are there and the response is no refusal. Null, which a filter
    takes for false, if a text is missing; plain comparisons reach the scan."""
    return (request != "") & (response != "") & ~opens_with(response, REFUSAL_OPENINGS)


def strip_improved_lead(response: Column) -> Column:
    """Drop the lead-in of a response that announces its improved answer."""
    body = F.btrim(F.btrim(_after_first_paragraph(response), F.lit("-")), F.lit("\n"))
    return F.when(F.lower(response).contains(IMPROVED_MARKER), strip(body)).otherwise(response)


# --- tokens ----------------------------------------------------------------------


def token_set(text: Column) -> Column:
    """Distinct word and punctuation tokens of any script, with the begin-of-text token
    that a model tokenizer puts into every set.

    Scripts without spaces give a token per character, so that a text in them is no single
    token. Characters are classed by Unicode properties; those younger than an engine's tables
    count as punctuation there.
    """
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.array_distinct(F.array_append(found, F.lit(BEGIN_OF_TEXT)))
