"""Text clean-up, instrument codes, fund classification and trading status."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters replaced one by one, then the direction marks that are dropped.
LETTERS_FROM = "يىكة"
LETTERS_TO = "ییکه"
DROPPED_MARKS = "\u200f\u200e"  # right-to-left mark, left-to-right mark
ZWNJ = "\u200c"
SPACE_RUN = "[ \\t\u00a0]+"

FUND_SECTOR = "68"
FUND_ISIN_PREFIX = "IRT"
COMMODITY_ISIN_PREFIX = "IRTK"
PRIMARY_SUFFIX = "0001"

FUND_TYPES = (
    "equity", "index", "sector", "leveraged", "fixed_income", "mixed", "commodity", "other",
)
EQUITY_FAMILY = ("equity", "index", "sector", "leveraged")

# Label of each type, as shown to readers.
TYPE_LABELS = {
    "equity": "سهامی",
    "index": "شاخصی",
    "sector": "بخشی",
    "leveraged": "اهرمی",
    "fixed_income": "درآمد ثابت",
    "mixed": "مختلط",
    "commodity": "کالایی",
    "other": "سایر",
}

# Words that name a type; the first that occurs decides.
TYPE_WORDS = (
    ("اهرم", "leveraged"),
    ("شاخص", "index"),
    ("بخشی", "sector"),
    ("درآمد ثابت", "fixed_income"),
    ("درآمدثابت", "fixed_income"),
    ("مختلط", "mixed"),
    ("کالا", "commodity"),
    ("طلا", "commodity"),
    ("ثابت", "fixed_income"),
    ("سهام", "equity"),
)
# Letter after the last dash of a fund's name.
TYPE_LETTERS = {"س": "equity", "ب": "sector", "د": "fixed_income", "م": "mixed"}
NAME_LETTER = r"-\s*(\S)\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_text(
    text: Column | str,
    letters: tuple[str, str] = (LETTERS_FROM, LETTERS_TO),
    dropped: str = DROPPED_MARKS,
) -> Column:
    """One spelling per letter, no marks, single joiners and spaces; null becomes empty."""
    mapped = F.translate(_col(text), letters[0] + dropped, letters[1])
    joined = F.regexp_replace(mapped, ZWNJ + "{2,}", ZWNJ)
    spaced = F.regexp_replace(joined, SPACE_RUN, " ")
    trimmed = F.regexp_replace(spaced, r"(?U)^\s+|\s+$", "")
    return F.coalesce(trimmed, F.lit(""))


def clean_code(code: Column | str) -> Column:
    return F.coalesce(F.trim(_col(code).cast("string")), F.lit(""))


def text_from_bytes(payload: Column | str) -> Column:
    """UTF-8 text of an archived body; bytes that are not UTF-8 become replacement marks."""
    return F.make_valid_utf8(_col(payload).cast("string"))


def is_fund_unit(isin: Column | str, sector: Column | str) -> Column:
    return (F.trim(_col(sector)) == FUND_SECTOR) & _col(isin).startswith(FUND_ISIN_PREFIX)


def is_primary_board(isin: Column | str) -> Column:
    return _col(isin).endswith(PRIMARY_SUFFIX)


def isin_stem(isin: Column | str) -> Column:
    """ISIN without the four characters that name the board."""
    i = _col(isin)
    return F.substring(i, F.lit(1), F.greatest(F.length(i) - 4, F.lit(0)))


def in_equity_family(fund_type: Column | str) -> Column:
    return _col(fund_type).isin(*EQUITY_FAMILY)


def type_label(fund_type: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, _col(fund_type)), F.lit(TYPE_LABELS["other"]))


def type_by_word(text: Column, words: tuple[tuple[str, str], ...] = TYPE_WORDS) -> Column:
    """Type of the first listed word found in the text, null when none is."""
    return F.coalesce(*[F.when(text.contains(word), F.lit(kind)) for word, kind in words])


def classify_fund(
    description: Column | str,
    name: Column | str,
    isin: Column | str,
    words: tuple[tuple[str, str], ...] = TYPE_WORDS,
    letters: dict[str, str] = TYPE_LETTERS,
    commodity_prefix: str = COMMODITY_ISIN_PREFIX,
) -> Column:
    """Fund type from the official description, else from the name; plain equity is refined."""
    desc, title = normalize_text(description), normalize_text(name)
    by_name = type_by_word(title, words)
    letter = F.regexp_extract(title, NAME_LETTER, 1)
    by_letter = F.coalesce(*[F.when(letter == x, F.lit(kind)) for x, kind in letters.items()])
    official = F.when(desc != "", F.coalesce(type_by_word(desc, words), F.lit("other")))
    base = F.coalesce(official, by_letter)
    refined = F.when(
        (base == "equity") & by_name.isin("leveraged", "index", "sector"), by_name
    )
    return F.when(_col(isin).startswith(commodity_prefix), F.lit("commodity")).otherwise(
        F.coalesce(refined, base, by_name, F.lit("other"))
    )


def status_kind(code: Column | str) -> Column:
    """Trading status; the second letter of the code outranks the first."""
    c = F.upper(F.trim(F.coalesce(_col(code), F.lit(""))))
    second = F.substring(c, 2, 1)
    return (
        F.when(second == "S", "suspended")
        .when(second == "R", "reserved")
        .when(second == "G", "blocked")
        .when(c.startswith("I"), "forbidden")
        .when(c == "A", "open")
        .otherwise("unknown")
    )


def is_halted(kind: Column | str) -> Column:
    return ~_col(kind).isin("open", "unknown")


def matches_search(needle: str, *texts: Column | str) -> Column:
    """Any of the texts contains the trimmed needle; an empty needle matches all."""
    wanted = needle.strip()
    hit = F.lit(wanted == "")
    for t in texts:
        hit = hit | F.coalesce(_col(t).contains(wanted), F.lit(False))
    return hit
