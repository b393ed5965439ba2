"""SQL fragments shared by the DuckDB twins."""

from __future__ import annotations

SPACE = (
    r"[ \t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def visible(x: str) -> str:
    return f"length(regexp_replace({x}, '{SPACE}+', '', 'g'))"


def html_text(x: str) -> str:
    bare = f"regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', '', 'g')"
    bare = f"regexp_replace({bare}, '(?is)<style[^>]*>.*?</style>', '', 'g')"
    return norm(f"regexp_replace({bare}, '<[^>]+>', ' ', 'g')")


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_\-]+')"


def sid(*parts: str) -> str:
    """sha256 over NUL-joined SQL expressions."""
    return "sha256(" + " || chr(0) || ".join(parts) + ")"


def chunk_ctes(source: str, key: str, text: str, size: int = 1500, overlap: int = 200, minimum: int = 120) -> str:
    """CTEs ending in ``chunks(key, ordinal, chunk_text, content_hash, char_start, char_end)``."""
    size = max(minimum, size)
    overlap = max(0, min(overlap, size // 2))

    def end(start: str) -> str:
        window = f"substr(t, {start} + 1, {size})"
        rpos = f"strpos(reverse({window}), ' ')"
        cut = f"({size} - {rpos})"
        return (
            f"CASE WHEN {start} + {size} >= n THEN n "
            f"WHEN {rpos} > 0 AND {cut} >= {minimum // 2} THEN {start} + {cut} + 1 "
            f"ELSE {start} + {size} END"
        )

    return f"""
    normed AS (SELECT {key}, {norm(text)} AS t FROM {source}),
    sized AS (SELECT {key}, t, length(t) AS n FROM normed WHERE length(t) > 0),
    cuts AS (
      SELECT {key}, t, n, CAST(0 AS BIGINT) AS s, CAST({end("0")} AS BIGINT) AS e FROM sized WHERE n >= {minimum}
      UNION ALL
      SELECT {key}, t, n, s2, CAST({end("s2")} AS BIGINT) FROM (
        SELECT {key}, t, n, CAST(CASE WHEN substr(t, nx + 1, 1) = ' ' THEN nx + 1 ELSE nx END AS BIGINT) AS s2 FROM (
          SELECT {key}, t, n, greatest(e - {overlap}, s + 1) AS nx FROM cuts WHERE e < n)
      ) WHERE s2 < n
    ),
    pieces AS (
      SELECT {key}, s, e, trim(substr(t, s + 1, e - s)) AS chunk_text FROM cuts
      WHERE length(trim(substr(t, s + 1, e - s))) >= {minimum}
      UNION ALL
      SELECT {key}, 0, n, t FROM sized WHERE n < {minimum}
    ),
    firsts AS (
      SELECT *, row_number() OVER (PARTITION BY {key}, chunk_text ORDER BY s) AS rn FROM pieces
    ),
    chunks AS (
      SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY s) - 1 AS INTEGER) AS ordinal,
             chunk_text, sha256(chunk_text) AS content_hash, s AS char_start, e AS char_end
      FROM firsts WHERE rn = 1
    )"""
