"""Text keys and checks as column expressions, and small Arrow helpers where Spark has no function for it."""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python strips as white space; tags; code marks; line breaks; placeholders.
BLANK = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
TAG = r"</?[A-Za-z][^<>\r\n]*>"
CODE = r"\{[^{}\r\n]*\}|\\[nr]|[\r\n]"
LINE_BREAK = r"\r\n|\r|\n|\\r\\n|\\[nr]"
PLACEHOLDER = r"\{[^{}\r\n]+\}|(?<!%)%(?:\d+\$)?[sd]"
STORY_KEY = r"^(story_(?:text|convenient))_(\d+)_Dialog_Detail"
OPTION_KEY = r"^(story_(?:text|convenient)_\d+)_Option(\d+)_"
VOICE_KEY = r"^char_voice_(?:words_[a-z]+_)?(\d{6})"
COMMENT_KEY = r"^(?:story_(?:(?:text|convenient)_)?\d+|char_voice_(?:words_[a-z]+_)?\d+)(?:_[A-Za-z0-9]+)+$"
# Speakers that name nobody, names of the player.
GENERIC_SPEAKERS = frozenset("旁白 系统 系统说明 系统文本 系统提示 群杂 众人 路人 npc".split())
PLAYER_NAMES = frozenset("玩家 主角 主人公 玩家(男) 玩家(女) {playername} 유저 플레이어 주인공 男主角 女主角 星临者".split())
FUZZY_PERCENT = 80


def strip(col: Column) -> Column:
    """Without BLANK at both ends; a trim looks at the ends only, a pattern at every character."""
    return F.btrim(col, F.lit(BLANKS))


def digest(col: Column) -> Column:
    """128 bits that stand for a text in joins and counts, as long lines are much to shuffle; empty stays empty."""
    return F.when(col == "", "").otherwise(F.md5(col))


def match_key(col: Column) -> Column:
    """Both ends stripped; null becomes empty."""
    return F.coalesce(strip(col), F.lit(""))


def punctuation_key(col: Column) -> Column:
    """The four equivalent marks in one form."""
    return F.replace(F.translate(col, "，；：", ",;:"), F.lit("…"), F.lit("..."))


def plain_key(col: Column, punctuation: bool = False) -> Column:
    """Text without tags, braces and line breaks."""
    plain = strip(F.regexp_replace(F.regexp_replace(match_key(col), TAG, ""), CODE, ""))
    return punctuation_key(plain) if punctuation else plain


def comparison_key(col: Column) -> Column:
    """Text without tags and line breaks; braces and marks count."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(col, F.lit("")), TAG, ""), LINE_BREAK, ""))


def trim_segment(col: Column) -> Column:
    return F.regexp_replace(col, rf"^(?:{BLANK}|\\[nr])+|(?:{BLANK}|\\[nr])+$", "")


def edge_newlines(col: Column) -> tuple[Column, Column]:
    """Whether the white space before and after the text has a line break."""
    head, tail = F.regexp_extract(col, f"^{BLANK}*", 0), F.regexp_extract(col, f"{BLANK}*$", 0)
    return head.rlike("[\r\n]"), tail.rlike("[\r\n]")


def align_newlines(value: Column, keep_start: Column, keep_end: Column) -> Column:
    """Give the edges of a value the line breaks of the baseline; blanks at the edges stay."""
    body = strip(value)
    head = F.regexp_extract(value, f"^{BLANK}*", 0)
    tail = F.when(body == "", F.lit("")).otherwise(F.regexp_extract(value, f"{BLANK}*$", 0))
    head_clean, tail_clean = (F.regexp_replace(x, "[\r\n]", "") for x in (head, tail))
    filled = body != ""
    new_head = F.when(~keep_start, head_clean).when(filled & ~head.rlike("[\r\n]"), F.concat(F.lit("\n"), head)).otherwise(head)
    new_tail = F.when(~keep_end, tail_clean).when(filled & ~tail.rlike("[\r\n]"), F.concat(tail, F.lit("\n"))).otherwise(tail)
    blank = F.when(keep_start & keep_end, value).otherwise(head_clean)
    return F.when(filled, F.concat(new_head, body, new_tail)).otherwise(blank)


def has_letters(col: Column) -> Column:
    return col.rlike(r"\p{L}")


def loose_key(col: Column) -> Column:
    """Letters and digits alone, lower case."""
    base = F.replace(F.regexp_replace(F.coalesce(col, F.lit("")), "_x000D_|\r", ""), F.lit("\\n"), F.lit("\n"))
    return F.regexp_replace(F.lower(F.translate(plain_key(base), "诶", "欸")), r"[^\p{L}\p{N}]", "")


def key_variants(col: Column) -> Column:
    """Loose keys of the alternatives between bars."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), r"\|(?!hpp\()"), loose_key)
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


# Fixed value: characters that the composed form may change.
COMPOSED = r"[\p{M}\u037e\u0387\u1100-\u11ff\u1f00-\u1fff\u2000\u2001\u2126\u212a\u212b\u2329\u232a\uf900-\ufaff\x{2f800}-\x{2fa1f}]"


def content_text(value: str | None) -> str:
    """Letters and digits of a text, composed, without tags, braces and paired bracket notes, lower case."""
    text = unicodedata.normalize("NFC", value or "").replace("_x000D_", "").replace("\\n", "\n").replace("\r", "").strip()
    text = breath_text(re.sub(CODE, "", re.sub(TAG, "", text)))
    return "".join(c for c in text.replace("诶", "欸").lower() if c.isalnum())


def content_key(col: Column) -> Column:
    """content_text() of a column: loose_key() where there are no brackets and nothing to compose."""
    special = col.rlike(f"[()（）]|{COMPOSED}")
    return F.when(special, _scalar(content_text, "string")(F.when(special, col))).otherwise(loose_key(col))


def content_variants(col: Column) -> Column:
    """content_text() of the alternatives between bars, empty ones left out, each once."""
    special = col.rlike(f"[()（）]|{COMPOSED}")
    cut = _scalar(lambda v: list(dict.fromkeys(filter(None, map(content_text, re.split(r"\|(?!hpp\()", v or ""))))), "array<string>")
    return F.when(special, cut(F.when(special, col))).otherwise(key_variants(col))


def number_of(col: Column) -> Column:
    """At most 18 digits as a number, else null."""
    return F.when(col.rlike(r"^\d{1,18}$"), col.try_cast("bigint"))


def story_number(key: Column) -> Column:
    return number_of(F.regexp_extract(key, STORY_KEY, 2))


def option_key(key: Column) -> tuple[Column, Column]:
    """Base and number of an option key; empty base and null number for other keys."""
    return F.regexp_extract(key, OPTION_KEY, 1), number_of(F.regexp_extract(key, OPTION_KEY, 2))


def voice_number(key: Column) -> Column:
    return F.regexp_extract(key, VOICE_KEY, 1)


def business_key(key: Column, comment: Column) -> Column:
    """The comment where the key is blank or a record number and the comment is a game key."""
    k, c = match_key(key), match_key(comment)
    return F.when(k.rlike(r"^(?:\d+(?:\.0+)?)?$") & c.rlike(COMMENT_KEY), c).otherwise(k)


def placeholders_agree(a: Column, b: Column) -> Column:
    return F.array_sort(F.regexp_extract_all(a, F.lit(PLACEHOLDER), 0)) == F.array_sort(F.regexp_extract_all(b, F.lit(PLACEHOLDER), 0))


def spreadsheet_safe(col: Column) -> Column:
    """A text that a spreadsheet would read as a formula gets a leading quote."""
    return F.when(col.rlike(rf"^{BLANK}*[=+\-@]"), F.concat(F.lit("'"), col)).otherwise(col)


def rate(part: Column, total: Column) -> Column:
    return F.try_divide(part.cast("double"), total.cast("double"))


def column_number(letters: Column) -> Column:
    """Column number of spreadsheet letters."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.ascii(c) - 64))


def column_letters(number: Column) -> Column:
    """Spreadsheet letters of a column number from 1 to 475,254 (four letters)."""

    def step(state: Column, _: Column) -> Column:
        left = state["left"] - 1
        more = F.concat(F.char(F.lit(65) + left % 26), state["letters"])
        return F.when(state["left"] > 0, F.struct(F.floor(left / 26).cast("long").alias("left"), more.alias("letters"))).otherwise(state)

    start = F.struct(number.cast("long").alias("left"), F.lit("").alias("letters"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, step, lambda state: state["letters"])


def evidence(lines: Column, label: str) -> Column:
    """Numbered lines of an array of struct(row, text)."""
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit(label), (i + 1).cast("string"), F.lit(" [row "), x["row"].cast("string"), F.lit("] "), x["text"])), "\n")


# ---- helpers in Python: each gets a whole Arrow batch of a column

_INNER = re.compile(r"\([^()（）]*\)|（[^()（）]*）")
_BRACKETS = frozenset("()（）")


def _mask_brackets(text: str, filler: str) -> str | None:
    """The text with every bracket group replaced by fillers, inner groups first; None if brackets do not pair."""
    while True:
        masked = _INNER.sub(lambda m: filler * len(m[0]), text)
        if masked == text:
            return None if _BRACKETS & set(text) else text
        text = masked


def breath_text(value: str | None) -> str:
    text = (value or "").strip()
    masked = _mask_brackets(text, "\0")
    return text if masked is None else masked.replace("\0", "").strip()


def tail_text(value: str | None) -> str:
    text = (value or "").strip()
    masked = _mask_brackets(text, "\0")
    return text if masked is None else text[: re.search(r"(?:\s*\0+)*$", masked).start()].rstrip() if masked.endswith("\0") else text


def lcs_similarity(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    if not a or not b:
        return float(a == b)
    # one bit a place of b, kept as long integers: a cleared bit is a place at which the subsequence grows
    places: dict[str, int] = {}
    for i, c in enumerate(b):
        places[c] = places.get(c, 0) | 1 << i
    free = whole = (1 << len(b)) - 1
    for c in a:
        met = free & places.get(c, 0)
        free = (free + met | free - met) & whole
    return 2 * (len(b) - free.bit_count()) / (len(a) + len(b))


def sequence_ratio(baseline: str, source: str) -> float:
    return difflib.SequenceMatcher(None, baseline, source, autojunk=False).ratio()


# Fixed value: a label before an option.
_LABEL = re.compile(r"(?:^|\s)([A-Z]|\d{1,2})(?:[.．](?!\d)|[、:：;；,，])\s*")


def option_list(value: str | None) -> list[str]:
    """Parts after labels 1..n or A..Z in order; empty unless there are two labels and no empty part."""
    text = unicodedata.normalize("NFC", value or "").replace("_x000D_", "").replace("\\n", "\n").replace("\r", "")
    pieces = _LABEL.split(text)  # before, label, part, label, part ...
    labels, parts = pieces[1::2], [p.strip() for p in pieces[2::2]]
    in_order = labels == [str(i + 1) for i in range(len(labels))] or labels == [chr(65 + i) for i in range(len(labels))]
    return parts if len(parts) > 1 and in_order and all(parts) and not pieces[0].strip() else []


_DISPLAY = re.compile(r"<(/?)(color|ruby)(?:\s*=[^<>]*|\s+[^<>]*)?>", re.I)


def tags_balanced(value: str | None) -> bool:
    opened: list[str] = []
    for closing, name in _DISPLAY.findall(value or ""):
        if not closing:
            opened.append(name.lower())
        elif not opened or opened.pop() != name.lower():
            return False
    return not opened


def _scalar(function, kind: str):
    @F.pandas_udf(kind)
    def over(values: pd.Series) -> pd.Series:
        return pd.Series([function(v) for v in values])

    return over


def _pairwise(function, kind: str):
    @F.pandas_udf(kind)
    def over(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([function(a or "", b or "") for a, b in zip(left, right, strict=True)])

    return over


def normalize(col: Column) -> Column:
    return _scalar(lambda v: unicodedata.normalize("NFKC", v or "").strip(), "string")(col)


def path_identity(col: Column) -> Column:
    return _scalar(lambda v: unicodedata.normalize("NFC", (v or "").replace("\\", "/")).casefold(), "string")(col)


def breath_key(col: Column) -> Column:
    return F.when(col.rlike("[()（）]"), _scalar(breath_text, "string")(col)).otherwise(match_key(col))


def tail_key(col: Column) -> Column:
    return F.when(col.rlike("[()（）]"), _scalar(tail_text, "string")(col)).otherwise(match_key(col))


def option_parts(col: Column) -> Column:
    """option_list() of a column; most texts have no two labels and are not asked."""
    label = "[A-Z0-9][.．、:：;；,，]"
    asked = col.rlike(rf"(?s){label}.*{label}|_x000D_|\r|{COMPOSED}")
    return F.when(asked, _scalar(option_list, "array<string>")(F.when(asked, col))).otherwise(F.array().cast("array<string>"))


def balanced_tags(col: Column) -> Column:
    return _scalar(tags_balanced, "boolean")(col)


def composed(col: Column) -> Column:
    return _scalar(lambda v: unicodedata.normalize("NFC", v or ""), "string")(col)


def speaker_variants(col: Column) -> Column:
    """Names that a speaker text may stand for, sorted: whole, without brackets, in brackets; none for generic speakers."""
    text = F.lower(F.regexp_replace(normalize(col), BLANK, ""))
    names = F.concat(F.array(text, F.regexp_replace(text, r"\([^)]*\)", "")), F.regexp_extract_all(text, F.lit(r"\(([^)]*)\)"), 1))
    named = F.array_sort(F.array_distinct(F.filter(names, lambda x: x.rlike("[^?？…]"))))
    nobody = (text == "") | text.isin(*sorted(GENERIC_SPEAKERS))
    return F.when(nobody, F.array().cast("array<string>")).when(text.isin(*sorted(PLAYER_NAMES)), F.array(F.lit("@player"))).otherwise(named)


def speaker_compare(a: Column, b: Column) -> Column:
    """1 for a shared name in two arrays of speaker_variants, -1 for none, 0 where a side names nobody."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(F.arrays_overlap(a, b), 1).otherwise(-1)


def lcs_ratio(a: Column, b: Column) -> Column:
    return _pairwise(lcs_similarity, "double")(a, b)


def ratio(baseline: Column, source: Column) -> Column:
    return _pairwise(sequence_ratio, "double")(baseline, source)
