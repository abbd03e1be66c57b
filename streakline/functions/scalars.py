"""Scalar rules as Column expressions; everything stays inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from streakline.functions import lookups as K

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- casts -------------------------------------------------------------------


def int_or(value: ColumnLike, default: int = 0) -> Column:
    """Whole number, or ``default`` when missing or not a whole number."""
    return F.coalesce(_col(value).try_cast("int"), F.lit(default))


def nonzero_double(value: ColumnLike) -> Column:
    """Number, or NULL when missing, invalid or zero."""
    return F.nullif(_col(value).try_cast("double"), F.lit(0.0))


def count_or_zero(value: ColumnLike) -> Column:
    """Number truncated to a whole count; anything else is 0."""
    return F.coalesce(_col(value).try_cast("double"), F.lit(0.0)).cast("int")


def localized(value: ColumnLike) -> Column:
    """Text of a name that is either plain text or an object with ``default``."""
    text = _col(value)
    is_object = text.startswith("{")
    return F.coalesce(F.when(is_object, F.get_json_object(text, "$.default")).otherwise(text), F.lit(""))


def is_season(value: ColumnLike) -> Column:
    return F.coalesce(_col(value).rlike("^[0-9]{8}$"), F.lit(False))


# --- time --------------------------------------------------------------------


def clock_seconds(value: ColumnLike) -> Column:
    """``MM:SS`` as seconds; 0 for anything else."""
    text = _col(value)
    one_colon = F.length(text) - F.length(F.replace(text, F.lit(":"))) == 1
    minutes = F.substring_index(text, ":", 1).try_cast("int")
    seconds = F.substring_index(text, ":", -1).try_cast("int")
    total = F.try_add(F.try_multiply(minutes, F.lit(60)), seconds)
    return F.coalesce(F.when(one_colon, total), F.lit(0))


def age_at(birth_date: ColumnLike, reference: ColumnLike) -> Column:
    """Completed years at ``reference``; NULL for a missing or malformed date."""
    born, at = _col(birth_date).try_cast("date"), _col(reference)

    def day_of_year(d: Column) -> Column:
        return F.month(d) * 100 + F.dayofmonth(d)

    before_birthday = (day_of_year(at) < day_of_year(born)).cast("int")
    return (F.year(at) - F.year(born) - before_birthday).cast("double")


def season_of_date(game_date: ColumnLike) -> Column:
    """Eight-digit season of a date: July starts the next one."""
    year = F.year(_col(game_date).cast("date"))
    first = F.when(F.month(_col(game_date).cast("date")) >= 7, year).otherwise(year - 1)
    return F.concat(first.cast("string"), (first + 1).cast("string"))


def season_start_year(season: ColumnLike) -> Column:
    return F.substring(_col(season).cast("string"), 1, 4).try_cast("int")


def season_for_year(year: ColumnLike) -> Column:
    """2016 -> 20162017."""
    return _col(year) * 10000 + _col(year) + 1


def season_label(season_id: ColumnLike) -> Column:
    """20162017 -> 2016-2017."""
    text = _col(season_id).cast("string")
    return F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 4))


# --- names and codes ----------------------------------------------------------


def full_name(first: ColumnLike, last: ColumnLike) -> Column:
    return F.concat(_col(first), F.lit(" "), _col(last))


def _words(name: ColumnLike) -> Column:
    return F.split(F.trim(F.regexp_replace(_col(name), r"\s+", " ")), " ")


def first_name(name: ColumnLike) -> Column:
    """First word of a name; a single word counts as the last name."""
    words = _words(name)
    return F.when(F.size(words) > 1, words[0]).otherwise(F.lit(""))


def last_name(name: ColumnLike) -> Column:
    words = _words(name)
    rest = F.array_join(F.slice(words, 2, F.size(words)), " ")
    return F.when(F.size(words) > 1, rest).otherwise(words[0])


def match_key(first: ColumnLike, last: ColumnLike) -> Column:
    return F.concat(F.lower(F.trim(_col(first))), F.lit(" "), F.lower(F.trim(_col(last))))


def match_key_of(name: ColumnLike) -> Column:
    return F.lower(F.trim(_col(name)))


def lookup(value: Column, table: Mapping) -> Column:
    """Value mapped through a small fixed table; unknown values pass through."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def team_code(raw: ColumnLike) -> Column:
    return lookup(F.upper(F.trim(F.coalesce(_col(raw), F.lit("")))), K.TEAM_ALIASES)


def source_name(raw: ColumnLike) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.SOURCE_ALIASES.items() for x in kv])
    trimmed = F.trim(_col(raw))
    return F.coalesce(F.try_element_at(table, F.lower(trimmed)), trimmed)


def is_source_header(raw: ColumnLike) -> Column:
    """Whether a sheet header names a forecast source."""
    key = F.lower(F.trim(_col(raw)))
    listed = key.isin(*K.NON_SOURCE_HEADERS)
    filler = key.rlike("^(unnamed|colonne)")
    age_like = (F.length(key) <= 5) & key.contains("ge")
    stem = F.regexp_replace(key, r"\.*2$", "")
    repeat = key.rlike("..2$") & stem.isin(*K.NON_SOURCE_HEADERS, *K.SOURCE_ALIASES)
    numbered = key.rlike(r"^hm\.[0-9]+$")
    return ~(listed | filler | age_like | repeat | numbered)


def position_group(position: ColumnLike) -> Column:
    """F for forwards, D for defense, ALL for anything else."""
    p = _col(position)
    return (
        F.when(p.isin(*K.FORWARD_POSITIONS), "F").when(p == K.DEFENSE_POSITION, "D").otherwise("ALL")
    )


def is_skater(position: ColumnLike) -> Column:
    """Not a goalie; an unknown position does not qualify."""
    return _col(position) != K.GOALIE_POSITION


def game_type_label(game_type: ColumnLike) -> Column:
    t = _col(game_type)
    known = reduce(
        lambda chain, kv: chain.when(t == kv[0], kv[1]), K.GAME_TYPE_LABELS.items(), F.when(F.lit(False), "")
    )
    return known.otherwise(F.concat(F.lit("Other ("), t.cast("string"), F.lit(")")))


def game_type_short(game_type: ColumnLike) -> Column:
    t = _col(game_type)
    return F.when(t == 2, "Reg").when(t == 3, "PO").otherwise(t.cast("string"))


# --- arithmetic ----------------------------------------------------------------


def ratio(numerator: ColumnLike, denominator: ColumnLike, default: float | None = 0.0) -> Column:
    """n / d where d is positive, else ``default``."""
    n, d = _col(numerator), _col(denominator)
    return F.when(d > 0, n / d).otherwise(F.lit(default).cast("double"))


def percent(part: ColumnLike, other: ColumnLike, digits: int = 1) -> Column:
    """Share of ``part`` in ``part + other``, in percent; 0 when both are 0."""
    total = _col(part) + _col(other)
    return F.when(total > 0, rounded(_col(part) / total * 100, digits)).otherwise(F.lit(0.0))


def per_hour(count: ColumnLike, seconds: ColumnLike, digits: int = 2) -> Column:
    minutes = _col(seconds) / F.lit(60.0)
    return F.when(_col(seconds) > 0, rounded(_col(count) / minutes * 60, digits)).otherwise(F.lit(0.0))


def rounded(value: ColumnLike, digits: int) -> Column:
    """Rounded to ``digits`` decimals, exact ties to the even neighbour."""
    scale = F.lit(10.0**digits)
    return F.rint(_col(value) * scale) / scale


def clip(value: ColumnLike, low: float, high: float) -> Column:
    return F.least(F.greatest(_col(value), F.lit(low)), F.lit(high))


def closer(a: ColumnLike, b: ColumnLike, a_label: str, b_label: str) -> Column:
    """Label of the smaller value; ties and NULLs go to ``b``."""
    return F.when(_col(a) < _col(b), a_label).otherwise(b_label)


def length_bucket(length: ColumnLike, single_until: int = 20, width: int = 5) -> Column:
    """Own bucket up to ``single_until``, then ranges such as 21-25."""
    n = _col(length)
    start = F.floor((n - 1) / width) * width + 1
    wide = F.concat_ws("-", start.cast("string"), (start + width - 1).cast("string"))
    return F.when(n > single_until, wide).otherwise(n.cast("string"))


# --- predicates ------------------------------------------------------------------


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def optional_filters(
    isin: Mapping[str, Sequence | None] | None = None,
    between: Mapping[str, tuple | None] | None = None,
) -> Column:
    """AND of the filters that are set; no filter at all keeps every row."""
    conditions = [F.col(c).isin(*v) for c, v in (isin or {}).items() if v]
    conditions += [F.col(c).between(*v) for c, v in (between or {}).items() if v]
    return all_of(conditions)


def name_contains(name: ColumnLike, text: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` keep their wildcard meaning."""
    return _col(name).ilike(f"%{text}%")


def rank_in(value: ColumnLike, ordered: Sequence[str]) -> Column:
    """Position in a fixed order, for sorting; 0 when absent."""
    return F.array_position(F.array(*[F.lit(x) for x in ordered]), _col(value))
