"""Hashes that any SQL engine gives alike: the first 32 bits of an MD5, spread by a linear rule."""

import hashlib

#: Values of a draw lie below this prime, so products stay within 64 bits.
PRIME = 2 ** 31 - 1


def multipliers(seed: int, index: int) -> tuple:
    """Factor and offset of one draw, by rule from the seed and the draw's number."""
    def number(part):
        return int(hashlib.md5(f"{seed}/{index}/{part}".encode()).hexdigest()[:8], 16)
    return 1 + number("factor") % (PRIME - 1), number("offset") % PRIME


def row_hash_sql(keys: list) -> str:
    """Spark SQL text of a number below ``PRIME`` from a row's keys."""
    return f"cast(conv(substring(md5(concat_ws('|', {', '.join(keys)})), 1, 8), 16, 10) AS bigint) % {PRIME}"


def duck_row_hash(keys: list) -> str:
    """The same number as DuckDB text."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8) AS BIGINT) % {PRIME}"


def draw_sql(row_hash: str, seed: int, index: int = 0) -> str:
    """One draw of a row, as text for either engine."""
    factor, offset = multipliers(seed, index)
    return f"(({row_hash}) * {factor} + {offset}) % {PRIME}"
