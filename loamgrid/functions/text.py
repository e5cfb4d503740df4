"""Text normalisers as columns. They are not interchangeable: each feeds an identity of its own."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def plain_words(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))


def plain_key(text: Column) -> Column:
    return F.array_join(plain_words(text), " ")


def squeezed(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


#: White space as Python's str.split sees it.
BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


@F.pandas_udf(StringType())
def compatible_form(texts: pd.Series) -> pd.Series:
    """Unicode form NFKC, in Arrow batches: Spark has no normal forms."""
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in texts], dtype=object)


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Full case folding, which differs from lower case for a few letters."""
    return texts.str.casefold()


def compatible_alnum(text: Column) -> Column:
    """Letters and numbers only, of the case-folded compatible form."""
    return F.regexp_replace(folded(compatible_form(text)), r"[^\p{L}\p{N}]", "")


def spaced(text: Column) -> Column:
    """Lower case, every run of anything but a-z and 0-9 one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def compatible_spaced(text: Column) -> Column:
    return spaced(compatible_form(text))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def collapsed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def answer_key(text: Column) -> Column:
    """Identity of short answers: case-folded, white space collapsed, closing full stops dropped."""
    return F.regexp_replace(collapsed(folded(text)), r"\.+$", "")


def unicode_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))


def fields(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, f"{BLANK}+"), lambda x: x != "")


# Headings that end a guideline's prose, openings of lines that its editors left, and what a link looks like.
END_HEADINGS = ["references", "external links", "see also"]
EDITORS_LINES = ["please take over this page", "there can be one or more than one editor-in-chief.", "file:"]
LINK = r"\[([^\]\n]+)\]\(https?://[^)]+\)"


def clean_prose(text: Column, end_headings: list[str] = END_HEADINGS, left_out: list[str] = EDITORS_LINES) -> Column:
    """A text's prose: what stands before the first Markdown heading of ``end_headings``, links as their texts, without lines that open like one of ``left_out`` (lower case), at most one blank line at a time."""
    names = "|".join(rf"\Q{h}\E" for h in end_headings)
    before = F.split(text, rf"(?imd)^#{{1,6}}\s*(?:{names})\s*$", 2)[0] if end_headings else text
    lines = F.split(F.regexp_replace(before, LINK, "$1"), "\n")

    def stays(line: Column) -> Column:
        return ~F.exists(F.array(*[F.lit(x) for x in left_out]), lambda x: F.startswith(F.lower(line), x))

    kept = F.filter(lines, stays) if left_out else lines
    return stripped(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"))


def cut_before(text: Column, markers: list[str]) -> Column:
    """What stands before the first of each marker, one marker after the other."""
    for m in markers:
        text = F.substring_index(text, m, 1)
    return text


def page_title(title: Column, url: Column) -> Column:
    """The title, else the decoded last part of the URL's path with blanks for underscores."""
    last = F.replace(F.element_at(F.split(F.regexp_extract(url, "^[^?#]*", 0), "/"), -1), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.replace(F.try_url_decode(last), F.lit("_"), F.lit(" ")), F.lit("")), url)


#: How an explanation opens with its answer's letter (fixed value).
ANSWER_LABEL = r"^\s*Answer\s*[:.-]?\s*[A-D]\s*[.)]?\s*"


def without_answer_label(text: Column) -> Column:
    """An explanation without a leading "Answer: B."."""
    return collapsed(F.regexp_replace(text, ANSWER_LABEL, ""))


#: Where an explanation's references begin, and how it names the right option (fixed values).
REFERENCE = r"(?i)\b(?:ref(?:erence)?\s*[:.]|references\s*:)"
ANSWER_MARK = r"(?i)\b(?:ans(?:wer)?\s*[.:-]?\s*|correct\s+(?:answer|option)\s+(?:is\s*)?[:.-]?\s*)\(?([a-d])\b"


def before_references(text: Column) -> Column:
    return F.regexp_replace(F.split(text, REFERENCE, 2)[0], ANSWER_MARK, " ")


def names_other_option(text: Column, label: Column) -> Column:
    """Whether some answer mark of the text names another option than ``label`` (a capital)."""
    return F.exists(F.regexp_extract_all(text, F.lit(ANSWER_MARK)), lambda x: F.upper(x) != label)


def thought(text: Column) -> Column:
    """struct<reasoning, final_answer, complete> of a completion: what stands before and after the first closing mark of the thought."""
    at = F.instr(text, "</think>")
    reasoning = stripped(F.regexp_replace(F.when(at > 0, F.substring_index(text, "</think>", 1)).otherwise(text), r"\A<think>", ""))
    final = F.when(at > 0, stripped(F.substr(text, at + 8))).otherwise("")
    return F.struct(reasoning.alias("reasoning"), final.alias("final_answer"), ((at > 0) & (reasoning != "") & (final != "")).alias("complete"))


def well_formed(text: Column, ended: Column) -> Column:
    """1 where the completion ended by itself, is complete and closes its thought once."""
    return (ended & (F.size(F.split(text, "</think>", -1)) == 2) & thought(text)["complete"]).cast("double")


def option_letter(text: Column) -> Column:
    """struct<strict, explicit>: the option that is the whole text, and the one that it opens with, also after "answer:"; null if none."""
    strict = F.regexp_extract(text, r"^\s*([ABCD])\s*[.)]?\s*$", 1)
    named = F.regexp_extract(text, r"^\s*(?i:(?:final\s+)?answer)\s*:\s*\*{0,2}([ABCDabcd])\*{0,2}(?:[.)]|\s*$)", 1)
    bare = F.regexp_extract(text, r"^\s*\*{0,2}([ABCD])\*{0,2}(?:[.)]|\s*$)", 1)
    none = F.lit("")
    return F.struct(F.nullif(strict, none).alias("strict"), F.upper(F.coalesce(F.nullif(named, none), F.nullif(bare, none))).alias("explicit"))


def without_brackets(text: Column) -> Column:
    """Endings of the story benchmark: titles as full stops, bracketed parts out, double blanks once replaced."""
    return F.replace(F.regexp_replace(F.replace(stripped(text), F.lit(" [title]"), F.lit(". ")), r"\[.*?\]", ""), F.lit("  "), F.lit(" "))


def restored_quote(quote: Column, content: Column) -> Column:
    """The part of ``content`` that ``quote`` matches but for white space, else ``quote``."""
    letters = F.filter(F.split(F.regexp_replace(quote, f"{BLANK}+", ""), ""), lambda c: c != "")
    pattern = F.array_join(F.transform(letters, lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), f"{BLANK}*")
    return F.when(F.size(letters) == 0, quote).otherwise(F.coalesce(F.nullif(F.regexp_substr(content, pattern), F.lit("")), quote))


def numbered_items(text: Column, most: int = 5) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(r"\d+\.\s*([^\n]+)")), 1, most)


def unfenced(text: Column) -> Column:
    """A JSON text without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(stripped(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def sub_queries(answer: Column, question: Column, most: int = 3, least: int = 5) -> Column:
    """Lines of an answer without their numbers, longer than ``least``; the question where there are none."""
    lines = F.transform(F.split(stripped(answer), "\n"), lambda x: F.regexp_replace(stripped(x), r"^[0-9.\-:：）) ]+", ""))
    kept = F.slice(F.filter(lines, lambda x: F.length(x) > least), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(question))


def blinded(text: Column, aliases: dict[str, str]) -> Column:
    """Names replaced by their mask, longest first."""
    for name in sorted(aliases, key=lambda n: (-len(n), n)):
        text = F.replace(text, F.lit(name), F.lit(aliases[name]))
    return text


def code_or_unknown(value: Column) -> Column:
    return F.when(value.rlike(r"^[A-Za-z_][A-Za-z0-9_.-]{0,100}\z"), value).otherwise("unknown")


def one_of(value: Column, allowed: list[str]) -> Column:
    return F.when(value.isin(*allowed), value).otherwise("unknown")


def size_limits(error: Column) -> Column:
    """struct<observed, chars, most> of an error that tells a metadata limit."""
    p = r"(?i)Metadata size \((\d+) chars\) exceeds the limit of (\d+) chars"
    n = [F.regexp_extract(error, p, i) for i in (1, 2)]
    return F.struct(F.coalesce(error.rlike(p), F.lit(False)).alias("observed"), *[F.nullif(x, F.lit("")).cast("bigint").alias(c) for x, c in zip(n, ("chars", "most"), strict=True)])


def sentences(text: Column, least: int = 40) -> Column:
    return F.filter(F.split(text, rf"(?<=[.!?]){BLANK}+"), lambda x: F.length(x) >= least)


def labelled_options(options: Column, labels: str = "ABCDE") -> Column:
    """An array of options as lines "A. ..."."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.substr(F.lit(labels), i + 1, F.lit(1)), F.lit(". "), x)), "\n")


def evidence_refs(ids: Column) -> Column:
    return F.transform(ids, lambda x: F.struct(x.alias("id")))


def json_at(text: Column, pointer: str) -> Column:
    """What a JSON pointer leads to, as text: ``~1`` is a slash and ``~0`` a tilde; a number is a place in an array; null if nothing is there."""
    path = "$"
    for token in pointer.split("/")[1:]:
        token = token.replace("~1", "/").replace("~0", "~")
        path += f"[{token}]" if token.isdigit() and str(int(token)) == token else f"['{token}']"
    return F.get_json_object(text, path)


def canonical_json(**columns: Column) -> Column:
    """A JSON object with keys in order and nulls kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprint(**columns: Column) -> Column:
    return F.sha2(canonical_json(**columns), 256)


def call_key(*parts: Column) -> Column:
    """The key of a call's cache: scope, operation, arguments."""
    return F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def rounded_up(value: Column, multiple: int) -> Column:
    return (F.ceil(value / multiple) * multiple).cast("bigint")


def best_option(scores: Column) -> Column:
    """The place, from 0, of the first greatest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def margin(losses: Column, gold: Column) -> Column:
    """The least loss of the other options less that of the right one (its place from 0)."""
    others = F.filter(losses, lambda x, i: i != gold)
    return F.array_min(others) - F.get(losses, gold)


def policy_loss(new: Column, old: Column, advantage: Column, low: float = 0.0003, high: float = 0.0004) -> Column:
    """The clipped loss of a sequence: ``new`` and ``old`` are arrays of token log probabilities."""
    mean = F.aggregate(F.zip_with(new, old, lambda a, b: a - b), F.lit(0.0), lambda a, x: a + x) / F.size(new)
    ratio = F.exp(mean)
    return -F.least(ratio * advantage, F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high)) * advantage)


def token_key(ids: Column) -> Column:
    """An identity of a sequence of token ids: the hash of its little-endian 32-bit numbers."""
    return F.sha2(F.unhex(F.array_join(F.transform(ids, lambda i: F.concat(*[F.lpad(F.hex(F.shiftright(i, 8 * b).bitwiseAND(255)), 2, "0") for b in range(4)])), "")), 256)
