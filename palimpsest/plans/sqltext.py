"""Pieces of DuckDB SQL shared by several queries."""

TILES = """px AS (
  SELECT vec_id AS img, label, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(greatest(0, least(255, floor((CAST(embedding[i] AS DOUBLE) + 0.5) * 255))) AS INT) AS v
  FROM (SELECT vec_id, label, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)
)"""


def boxed(source: str, name: str, radius: int, value: str, keys: str = "img") -> str:
    """CTEs that add box sums of value to source, as column b, under the given name."""
    return f"""{name}_r AS (SELECT *, sum({value}) OVER (PARTITION BY {keys}, y ORDER BY x ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS r_ FROM {source}),
{name} AS (SELECT * EXCLUDE (r_), sum(r_) OVER (PARTITION BY {keys}, x ORDER BY y ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS b FROM {name}_r)"""


def inked(source: str, name: str, keys: str = "img") -> str:
    """CTEs of locally thresholded ink of source, radius 4."""
    over = "OVER (PARTITION BY {k}, {a} ORDER BY {o} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)"
    a, d = over.format(k=keys, a="y", o="x"), over.format(k=keys, a="x", o="y")
    return f"""{name}_1 AS (SELECT *, sum(1) {a} AS n1, sum(v) {a} AS s1, sum(v * v) {a} AS q1 FROM {source}),
{name}_2 AS (SELECT *, sum(n1) {d} AS n2, sum(s1) {d} AS s2, sum(q1) {d} AS q2 FROM {name}_1),
{name} AS (SELECT * EXCLUDE (n1, s1, q1, n2, s2, q2), CASE WHEN v < (s2 / n2) * (1 + 0.25 * (sqrt(greatest(0.0, q2 / n2 - (s2 / n2) * (s2 / n2))) / 128.0 - 1)) THEN 1 ELSE 0 END AS ink FROM {name}_2)"""


def fold(s: str) -> str:
    """Umlauts spelled out in upper case."""
    return f"replace(replace(replace(replace(replace(upper({s}), 'Ä', 'AE'), 'Ö', 'OE'), 'Ü', 'UE'), 'ß', 'SS'), 'ẞ', 'SS')"


def translit(s: str) -> str:
    """Folded, letters only."""
    return f"regexp_replace({fold(s)}, '[^A-Z]', '', 'g')"
