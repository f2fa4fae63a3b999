"""Title keys, section labels and other scalar functions, as column expressions.

Five title keys exist and differ on purpose: `title_key` keeps inner punctuation, `match_key` keeps underscores,
`bare_key` drops labels first, `merge_key` keeps letters and digits only, `model_text` folds digits.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that Python strips and splits at, as a character class.
WS = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# The same, as the characters themselves.
WS_CHARS = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

# Patterns of section labels, contents pages and headings.
SECTION_LABEL = (
    r"(\d+(?:\.\d+)+\.?|\d+\.|\d{1,2}|[A-Za-z](?:\.\d+)+\.?|[IVXLivxl]{2,5}\.|[A-Za-z]\.)"
)
WORD_LABEL = r"(?i)\A(chapter|appendix|part|section|annex)\s+(\d+|[ivxl]+|[a-z])\b[.:]?\s+"
CONTENTS_HEADING = r"(?i)\A(table of )?contents\z"
CONTENTS_ROW = r"\A(.+?)[\s.]{2,}(\d{1,4})\z"
NUMBERING = r"\A(\d+(?:\.\d+)*)[.\s]\s*"
CHAPTER = r"(?i)\A(chapter|part|appendix)\s+([0-9ivxlc]+)\b"
NUMBERED = r"\A\d+(?:\.\d+)*[.\s]\s*\S"

PREFIX_CHARS = 8


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{WS[1:]}+"))


def section_label(title: Column) -> Column:
    """The leading section label ("4.1" of "4.1 Results"), or an empty string."""
    return F.regexp_extract(strip(title), rf"\A{SECTION_LABEL}\s+", 1)


def strip_labels(title: Column) -> Column:
    """Without a leading word label and then without a leading section label; never empty unless the title is blank."""
    s = strip(title)
    w = F.regexp_replace(s, WORD_LABEL, "")
    s = F.when(strip(w) != "", w).otherwise(s)
    r = F.regexp_replace(s, rf"\A{SECTION_LABEL}\s+", "")
    return F.when(strip(r) != "", r).otherwise(s)


def label_depth(text: Column) -> Column:
    """4 -> 1, 4.1 -> 2, no label -> 0."""
    label = F.regexp_replace(section_label(text), r"\.+\z", "")
    return F.when(label == "", 0).otherwise(F.size(F.filter(F.split(label, r"\."), lambda x: x != "")))


def title_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(strip(c), r"\A\.+|\.+\z", "")), f"{WS}+", " ")


def match_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}_{WS[1:]}", ""))


def bare_key(c: Column) -> Column:
    return match_key(strip_labels(c))


def _letters_key(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), rf"[^\p{{L}}\p{{N}}{WS[1:]}", ""))


def merge_key(c: Column) -> Column:
    return _letters_key(strip_labels(c))


def plain_key(c: Column) -> Column:
    return title_key(strip_labels(c))


#: Keys that `with_keys` makes, and their types.
MADE = {"k_title": pa.string(), "k_match": pa.string(), "k_bare": pa.string(), "k_merge": pa.string(), "k_plain": pa.string(), "n_words": pa.int32(), "contents": pa.int32()}
# Fixed values of `contents`.
HEADING, ROW = 1, 2


def with_keys(df: DataFrame, text: str, *names: str) -> DataFrame:
    """df with the keys of its column `text` that it does not carry yet: k_title, k_match, k_bare, k_merge, k_plain, n_words, contents.

    They are what title_key, match_key, bare_key, merge_key, plain_key and n_words give; contents is HEADING or ROW where
    is_heading or is_row of the stripped text hold, else 0.  Line and entry tables may carry
    them ready-made (see `sources.views`).  All those wanted are made in one pass of Arrow batches, since Java's classes of
    characters test each character of a line against a dozen ranges, once a key and step.
    """
    want = [n for n in names if n not in df.columns]
    if not want:
        return df
    made = df.withColumn("_keys", _keys_of(tuple(want))(F.col(text)))
    return made.select(*df.columns, *(F.col("_keys")[n].alias(n) for n in want))


@cache
def _keys_of(names: tuple[str, ...]):
    fields = ", ".join(f"{n} {'int' if n in ('n_words', 'contents') else 'string'}" for n in names)

    @F.arrow_udf(f"struct<{fields}>")
    def keys(text: pa.Array) -> pa.Array:
        rows = [python_keys(t, names) for t in text.to_pylist()]
        columns = zip(*rows, strict=True) if rows else ((),) * len(names)
        return pa.StructArray.from_arrays([pa.array(c, MADE[n]) for n, c in zip(names, columns, strict=True)], list(names))

    return keys


_WORD, _SECTION = re.compile(WORD_LABEL, re.ASCII), re.compile(rf"\A{SECTION_LABEL}\s+", re.ASCII)
_HEADING = re.compile(CONTENTS_HEADING.replace(r"\z", r"\Z"), re.ASCII)
# what a dot of Java's patterns leaves out
_ROW = re.compile(CONTENTS_ROW.replace(".+?", r"[^\n\r\x85\u2028\u2029]+?").replace(r"\z", r"\Z"), re.ASCII)
_MARKS = re.compile(r"[^\w\s]+")
_ASCII_MARKS = {c: None for c in range(128) if _MARKS.match(chr(c))}


def _bare(text: str) -> str:
    s = text.strip()
    for label in (_WORD, _SECTION):
        w = label.sub("", s, count=1)
        s = w if w.strip() else s
    return s


def _title(text: str) -> str:
    s = text.strip().strip(".").lower()
    out = " ".join(s.split())
    # dots may have hidden white space, which is no end of the title
    return f"{' ' if s[:1].isspace() else ''}{out}{' ' if out and s[-1:].isspace() else ''}"


def _match(text: str) -> str:
    s = text.lower()
    return " ".join((s.translate(_ASCII_MARKS) if s.isascii() else _MARKS.sub("", s)).split())


def _contents(text: str) -> int:
    s = text.strip()
    if "0" <= s[-1:] <= "9":
        return ROW if _ROW.match(s) else 0
    return HEADING if len(s) <= 17 and _HEADING.match(s) else 0


def python_keys(text: str | None, names: tuple[str, ...]) -> tuple:
    """The keys named of one text, in their order."""
    if text is None:
        return (None,) * len(names)
    out, bare, match = [], None, None
    for n in names:
        if n == "n_words":
            out.append(len(text.split()))
        elif n == "contents":
            out.append(_contents(text))
        elif n == "k_title":
            out.append(_title(text))
        elif n == "k_plain":
            out.append(_title(_bare(text)))
        elif n == "k_match":
            match = _match(text)
            out.append(match)
        else:
            if bare is None:
                s = _bare(text)
                bare = match if match is not None and len(s) == len(text.strip()) else _match(s)
            out.append(bare if n == "k_bare" or "_" not in bare else " ".join(bare.replace("_", "").split()))
    return tuple(out)


def model_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(c), r"\p{Nd}+", "#"))


def prefix_match(candidate: Column, target: Column) -> Column:
    """Equal, or one of at least PREFIX_CHARS characters begins the other; never with an empty side."""
    long = lambda a, b: (F.char_length(a) >= PREFIX_CHARS) & F.startswith(b, a)
    return (candidate != "") & (target != "") & ((candidate == target) | long(target, candidate) | long(candidate, target))


def titles_match(a_key: Column, a_bare: Column, b_key: Column, b_bare: Column) -> Column:
    bare = ((a_key != a_bare) | (b_key != b_bare)) & prefix_match(a_bare, b_bare)
    return prefix_match(a_key, b_key) | bare


def numbering_level(title: Column) -> Column:
    """Dots of a leading number plus one; null without one."""
    n = F.regexp_extract(title, NUMBERING, 1)
    return F.when(n != "", F.char_length(n) - F.char_length(F.replace(n, F.lit("."), F.lit(""))) + 1)


def is_row(s: Column) -> Column:
    """Whether a stripped text is a row of contents.  Its last character is looked at first: that rules out most lines."""
    return F.right(s, F.lit(1)).between("0", "9") & s.rlike(CONTENTS_ROW)


def is_heading(s: Column) -> Column:
    """Whether a stripped text is the heading of contents, which has at most 17 characters."""
    return (F.char_length(s) <= 17) & s.rlike(CONTENTS_HEADING)


def contents_heading(lines: DataFrame) -> Column:
    """Whether a line is the heading of contents; lines may carry `contents`, which saves stripping them."""
    return F.col("contents") == HEADING if "contents" in lines.columns else is_heading(strip(F.col("text")))


def contents_row(lines: DataFrame) -> Column:
    """The like of a row of contents."""
    return F.col("contents") == ROW if "contents" in lines.columns else is_row(strip(F.col("text")))


def in_contents(lines: DataFrame) -> Column:
    return contents_heading(lines) | contents_row(lines)


def is_contents_row(text: Column) -> Column:
    s = strip(text)
    return is_heading(s) | is_row(s)


def is_furniture(text: Column) -> Column:
    return strip(text).rlike(r"\A[\p{Nd}²³¹⁰-⁹₀-₉]+\z")


# Fixed value: no lower-case letter of ASCII and one upper-case one at least.
ALL_CAPS = r"\A[^a-z]*[A-Z][^a-z]*\z"


def all_caps(text: Column) -> Column:
    return text.rlike(ALL_CAPS)


def split_of(sha: Column, train: float = 0.8, val: float = 0.1) -> Column:
    """train, val or test by the first 32 bits of a hash, modulo 1000."""
    bucket = F.conv(F.substring(sha, 1, 8), 16, 10).cast("long") % 1000
    return F.when(bucket < F.lit(train * 1000), "train").when(bucket < F.lit((train + val) * 1000), "val").otherwise("test")


def provider(spec: Column) -> Column:
    return F.substring_index(spec, ":", 1)


def model_name(spec: Column) -> Column:
    at = F.instr(spec, ":")
    return F.when(at > 0, F.substring(spec, at + 1, F.char_length(spec))).otherwise("")


def client_ip(forwarded: Column, peer: Column) -> Column:
    """The last forwarded address, else the peer's, else `unknown`."""
    last = strip(F.element_at(F.split(forwarded, ","), -1))
    return F.coalesce(F.when(F.coalesce(forwarded, F.lit("")) != "", last), peer, F.lit("unknown"))


def safe_filename(identifier: Column) -> Column:
    return F.concat(F.replace(identifier, F.lit("/"), F.lit("_")), F.lit(".pdf"))


def teacher_failure(message: Column) -> Column:
    return F.when(message.rlike(r"(?i)exceed\w*\s+context\s+window"), "context-too-long").otherwise("teacher-error")


# What a user is told, by kind of failure.
FRIENDLY = {
    "InvalidPdf": "This file could not be read as a PDF.",
    "Encrypted": "This PDF is password-protected. Remove the encryption and try again.",
    "NoTextLayer": "This PDF appears to be scanned and no text could be read from it, even after OCR.",
    "NoOutline": "No table of contents or headings could be detected in this PDF.",
    "LLMVerification": "LLM verification failed. Check the API key and model, or set LLM mode to Auto or Never and retry.",
    "UnknownProvider": "Unknown LLM provider in the model selection.",
    "OcrPageLimit": "This scanned PDF is too long to process (the OCR page limit is set by the server). Try a shorter document.",
    "OcrUnavailable": "This server can't process scanned PDFs right now.",
    "Labeler": "The heading model is unavailable on this server.",
}


def friendly_error(kind: Column) -> Column:
    out = F.lit("Processing failed unexpectedly. Please try again.")
    for name, said in FRIENDLY.items():
        out = F.when(kind == name, said).otherwise(out)
    return out


def render_dpi(area_square_inches: Column) -> Column:
    """Dots per inch for a page: 72 to 300, within 40 million pixels."""
    return F.greatest(F.lit(72), F.least(F.lit(300), F.sqrt(F.lit(40e6) / F.greatest(area_square_inches, F.lit(1e-6))).cast("int")))
