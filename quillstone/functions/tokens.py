"""Column expressions over single tokens: normalising, segmenting, slot grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of any kind, and the same as a class that Java's and RE2's patterns both read.
WHITES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WHITE = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Symbol groups that count as one unit, for segmenting in general and for the slot grammar; the slots; the sections.
UNITS = ("aiiin", "aiin", "ain", "cth", "ckh", "cph", "cfh", "eee", "iii", "ch", "sh", "ee", "ii", "ol", "or", "al", "ar")
SLOT_UNITS = ("cth", "ckh", "cph", "cfh", "eee", "iii", "ch", "sh", "ee", "ii", "ol", "or", "al", "ar")
GALLOWS = ("k", "t", "p", "f")
#: The slots in order: name, units it takes, whether it may be empty, how many units at most.
SLOTS = (
    ("prefix", ("d", "s", "l", "q", "o"), True, 1),
    ("gallows", GALLOWS, True, 1),
    ("core", ("o", "a", "e", "i", "ch", "sh", "ol", "or", "al", "ar", "ee", "eee", "ii", "iii"), False, 2),
    ("suffix", ("y", "m", "n", "r", "l", "s"), True, 1),
)
#: Ends each unit in a segmented token; control characters do not occur in tokens.
MARK = "\x01"
SECTIONS = (("herbal", 1, 66), ("astronomical", 67, 67), ("cosmological", 68, 73), ("biological", 75, 84), ("pharmaceutical", 88, 102), ("recipes", 103, 116))


def place(line: str = "line_ord", pos: str = "pos") -> Column:
    """Where a token stands, as one number in the order of lines and of places in them.

    Its smallest value is kept by hash aggregation, which a pair of numbers
    would not be.
    """
    return F.col(line).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(pos)


def place_in(df: DataFrame) -> Column:
    """``place`` of a table's rows, from ``line_start`` where it has that: a whole number by which all places are told apart."""
    return F.col("line_start") + F.col("pos") if "line_start" in df.columns else place()


def tokenise(text: Column) -> Column:
    """Full stops and hyphens separate like white space; other marks stay."""
    return plain_tokens(F.translate(text, ".-", "  "))


def plain_tokens(text: Column) -> Column:
    """The runs without white space: all of it is made blanks first, as splitting on one character needs no pattern."""
    return F.array_remove(F.split(F.translate(text, WHITES, " " * len(WHITES)), " "), "")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(text, F.lit(WHITES))


def strip_uncertainty(token: Column) -> Column:
    return F.regexp_replace(token, "[{}]", "")


def strip_damage(token: Column) -> Column:
    return F.regexp_replace(token, "[!?]", "")


def has_uncertainty(token: Column) -> Column:
    """Whether a token has any mark of doubt; a line's flag looks at braces alone."""
    return token.rlike("[{}!?]")


def line_has_uncertainty(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: t.rlike("[{}]"))


def clean_tokens(tokens: Column) -> Column:
    """Tokens without braces. One that held nothing else becomes empty and still counts."""
    return F.transform(tokens, strip_uncertainty)


def normalise(token: Column, strip_uncertain: bool = False, lowercase: bool = True) -> Column:
    token = F.lower(token) if lowercase else token
    return strip_damage(strip_uncertainty(token)) if strip_uncertain else token


def normalise_sequence(tokens: Column, strip_uncertain: bool = False, lowercase: bool = True) -> Column:
    return F.filter(F.transform(tokens, lambda t: normalise(t, strip_uncertain, lowercase)), lambda t: t != "")


def units(token: Column, groups: tuple[str, ...] = UNITS) -> Column:
    """Greedy, longest group first; equal to a scan from the left, as every other character is a unit. ``groups`` may be a caller's own."""
    longest = sorted((g for g in groups if g), key=lambda g: (-len(g), g))
    return F.regexp_extract_all(token, F.lit("((?s)" + "|".join([*map(_quoted, longest), "."]) + ")"), 1)


def _quoted(text: str) -> str:
    """``text`` as a pattern that matches it and nothing else."""
    return "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in text)


def join_units(units: Column) -> Column:
    """The token that units were cut from."""
    return F.array_join(units, "")


def token_length(token: Column, in_units: bool = True) -> Column:
    plain = strip_uncertainty(token)
    return F.size(units(plain)) if in_units else F.char_length(plain)


def is_gallows(token: Column) -> Column:
    return F.arrays_overlap(units(strip_uncertainty(F.lower(token))), F.array(*map(F.lit, GALLOWS)))


def skeleton(text: Column) -> Column:
    """What is left without vowels, in upper case."""
    return F.upper(F.regexp_replace(F.lower(text), "[aeiou]", ""))


def classify_folio(folio: Column) -> Column:
    number = F.regexp_extract(F.lower(folio), "^f([1-9][0-9]{0,2})[rv]$", 1)
    n = F.when(number != "", number.cast("int"))
    out = F.lit("unknown")
    for name, low, high in reversed(SECTIONS):
        out = F.when(n.between(low, high), name).otherwise(out)
    return out


def segmented(token: Column) -> Column:
    """The token before the first slot: its units, each ended by ``MARK``."""
    return F.regexp_replace(F.regexp_replace(token, "[{}!?]", ""), f"((?s){'|'.join(SLOT_UNITS)}|.)", f"$1{MARK}")


def after_slot(state: Column, k: int) -> Column:
    """The segmented token after slot ``k``, which takes what it can from the front and gives nothing back."""
    _, permitted, _, most = SLOTS[k]
    return F.regexp_replace(state, f"^(?:(?:{'|'.join(permitted)}){MARK}){{1,{most}}}", "")


def slot_states(token: Column) -> list[Column]:
    """The segmented token before the first slot and after each."""
    out = [segmented(token)]
    for k in range(len(SLOTS)):
        out.append(after_slot(out[-1], k))
    return out


def validate(token: Column, states: list[Column] | None = None) -> Column:
    """STRUCT<is_valid, matched_slots, failure_category, confidence> of a token under the slot grammar; ``states``: its ``slot_states``, where these are columns already."""
    s = states or slot_states(token)
    marks = has_uncertainty(token)
    empty, core = s[0] == "", s[3] != s[2]
    valid = core & (s[4] == "")
    before = [F.when(s[k] != s[k - 1], F.lit(SLOTS[k - 1][0])).otherwise("") for k in (1, 2, 3)]
    after = F.when(core & (s[4] != s[3]), F.lit("suffix")).otherwise("")
    matched = F.array_remove(F.array(*before, after), "")
    return F.struct(
        valid.alias("is_valid"), F.when(empty, F.array().cast("array<string>")).otherwise(matched).alias("matched_slots"),
        F.when(empty, "empty_token").when(~core, "missing_required_slot").when(~valid, "unconsumed_units").alias("failure_category"),
        F.when(valid & marks, "medium").when(valid, "high").when(marks | empty, "low").otherwise("medium").alias("confidence"),
    )
