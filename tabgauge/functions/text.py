"""SQL for text forms of values, made to look like Python's ``str`` and ``repr``.

Arguments are SQL expressions, by preference plain column names.
"""

from __future__ import annotations

import math

from pyspark.sql import types as T

from tabgauge.functions import dtypes
from tabgauge.functions.frames import sql_double, sql_text

DAYS_PER_YEAR = 365.2425
SECONDS_PER_DAY = 86400


def say(*pieces: str) -> str:
    """Concatenate SQL texts; null if any of them is null."""
    return f"concat({', '.join(pieces)})"


def fixed(value: str, digits: int) -> str:
    """Exactly ``digits`` decimals (11 at most), rounded from the binary value; half goes to even.

    All digits of the binary value are shown below 1e37; beyond that zeros follow the shortest text.
    """
    pattern = "0." + "0" * digits
    # Java writes zeros after the shortest text of a double. From here on doubles lie further apart
    # than the last decimal, so that decimals beyond that text differ from zero.
    exact_from = 2.0**52 / 10**digits
    return (
        f"case when isnan({value}) then 'nan' "
        f"when {value} = double('inf') then 'inf' "
        f"when {value} = double('-inf') then '-inf' "
        f"when abs({value}) >= {sql_double(exact_from)} and abs({value}) < {sql_double(2.0**62)} "
        f"then {_binary_fraction(value, digits)} "
        f"when abs({value}) >= {sql_double(2.0**62)} and abs({value}) < 1e37 then {_binary_whole(value, digits)} "
        f"else format_number({value}, '{pattern}') end"
    )


def _binary_fraction(value: str, digits: int) -> str:
    """SQL for a double of 2**52 / 10**digits to 2**62, whose fraction ends with the binary place ``places``."""
    places = math.ceil(digits * math.log2(10))
    step = 1 << (places - digits)
    # Decimals of the fraction are ``m / step``.
    split = (
        f"v -> named_struct('negative', v < 0, 'whole', floor(abs(v)), "
        f"'m', bigint((abs(v) - floor(abs(v))) * {sql_double(2.0**places)}) * {5**digits}L)"
    )
    odd_or_more = f"2 * (x.m % {step}L) > {step}L or (2 * (x.m % {step}L) = {step}L and x.m div {step}L % 2 = 1)"
    rounded = (
        f"x -> named_struct('negative', x.negative, 'whole', x.whole, 'decimals', x.m div {step}L + if({odd_or_more}, 1, 0))"
    )
    shown = (
        f"x -> concat(if(x.negative, '-', ''), x.whole + x.decimals div {10**digits}L, '.', "
        f"lpad(cast(x.decimals % {10**digits}L as string), {digits}, '0'))"
    )
    return f"transform(transform(transform(array({value}), {split}), {rounded}), {shown})[0]"


def _binary_whole(value: str, digits: int) -> str:
    """SQL for a double of 2**62 to 1e37, which is a whole number."""
    unit = sql_double(2.0**62)
    split = (
        f"v -> named_struct('negative', v < 0, 'high', floor(abs(v) / {unit}), "
        f"'low', bigint(abs(v) - double(floor(abs(v) / {unit})) * {unit}))"
    )
    digit_text = f"cast(cast(x.high as decimal(19, 0)) * {1 << 62}BD + x.low as string)"
    shown = f"x -> concat(if(x.negative, '-', ''), {digit_text}, '.{'0' * digits}')"
    return f"transform(transform(array({value}), {split}), {shown})[0]"


def float_text(value: str) -> str:
    """Shortest text of a double: plain from 1e-4 up to 1e16, else ``1e+16``."""
    java = f"cast({value} as string)"
    plain = (
        f"regexp_replace(cast(try_cast({java} as decimal(38, 21)) as string), "
        r"'(\\.[0-9]+?)0+$', '$1')"
    )
    mantissa = rf"regexp_replace(split_part({java}, 'E', 1), '\\.0$', '')"
    power = f"try_cast(split_part({java}, 'E', 2) as int)"
    size = f"cast(abs({power}) as string)"
    digits = f"if(abs({power}) < 10, concat('0', {size}), {size})"
    return (
        f"case when isnan({value}) then 'nan' "
        f"when {value} = double('inf') then 'inf' "
        f"when {value} = double('-inf') then '-inf' "
        f"when {value} = 0 or abs({value}) between 1e-3 and 9999999 then {java} "
        f"when abs({value}) >= 1e-4 and abs({value}) < 1e16 then {plain} "
        f"else concat({mantissa}, if({power} < 0, 'e-', 'e+'), {digits}) end"
    )


def temporal_text(value: str, dtype: T.DataType) -> str:
    """``2024-01-01 00:03:52.824425``, microseconds only when there are any."""
    if dtypes.semantic_type(dtype) != dtypes.DATETIME:
        return f"cast({value} as string)"
    zone = "xxx" if isinstance(dtype, T.TimestampType) else ""
    return (
        f"case when date_format({value}, 'SSSSSS') = '000000' "
        f"then date_format({value}, 'yyyy-MM-dd HH:mm:ss{zone}') "
        f"else date_format({value}, 'yyyy-MM-dd HH:mm:ss.SSSSSS{zone}') end"
    )


def value_text(value: str, dtype: T.DataType) -> str:
    """A category; null reads ``None``."""
    if isinstance(dtype, T.BooleanType):
        text = f"if({value}, 'True', if(not {value}, 'False', null))"
    elif dtypes.has_nan(dtype):
        text = float_text(value)
    else:
        text = temporal_text(value, dtype)
    return f"coalesce({text}, 'None')"


def quoted(value: str) -> str:
    """A string in quotes, the way it shows inside a printed dictionary."""
    body = value
    for raw in ("\\", "\n", "\r", "\t"):
        shown = raw.encode("unicode_escape").decode()
        body = f"replace({body}, {sql_text(raw)}, {sql_text(shown)})"
    single, double = f"instr({value}, {sql_text(chr(39))})", f"instr({value}, '\"')"
    return (
        f"if({single} > 0 and {double} = 0, concat('\"', {body}, '\"'), "
        f"concat({sql_text(chr(39))}, replace({body}, {sql_text(chr(39))}, "
        f"{sql_text(chr(92) + chr(39))}), {sql_text(chr(39))}))"
    )


def bin_key(lower: str, upper: str) -> str:
    """``[lower,upper]`` with ten decimals, or ``-inf`` and ``inf``."""
    return say("'['", fixed(lower, 10), "','", fixed(upper, 10), "']'")


def span_text(seconds: str) -> str:
    """A time span in years and days, days and hours, or hours to seconds."""
    days = f"({seconds} div {SECONDS_PER_DAY})"
    hours = f"({seconds} % {SECONDS_PER_DAY} div 3600)"
    years = float_text(f"({days} / {DAYS_PER_YEAR}D)")
    rest = float_text(f"(double({days}) % {DAYS_PER_YEAR}D)")
    return (
        f"case when {days} > {DAYS_PER_YEAR}D "
        f"then {say(years, sql_text(' years, '), rest, sql_text(' days'))} "
        f"when {days} > 0 "
        f"then {say(days, sql_text(' days, '), hours, sql_text(' hours'))} "
        f"else concat({hours}, ' hours, ', {seconds} % 3600 div 60, ' minutes, ', "
        f"{seconds} % 60, ' seconds') end"
    )
