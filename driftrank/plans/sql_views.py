"""DuckDB twins of the logical tables (independent SQL, used by the oracle).

Each entry is a CTE body over the raw driver views.
"""

from __future__ import annotations

VIEWS = {
    "customers_l": "SELECT CAST(c_custkey AS VARCHAR) AS customer_id FROM customer",
    "articles_l": (
        "SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS article_id, p_name AS prod_name, "
        "p_brand AS product_type_name, p_type AS product_group_name, "
        "CAST(p_size AS VARCHAR) AS graphical_appearance_name, "
        "CAST(CAST(floor(p_size / 10) AS BIGINT) AS VARCHAR) AS index_group_name FROM part"
    ),
    "tx_l": (
        "SELECT CAST(o_orderdate AS DATE) AS t_dat, CAST(o_custkey AS VARCHAR) AS customer_id, "
        "lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS article_id, l_extendedprice AS price, "
        "2 AS sales_channel_id, CAST(NULL AS VARCHAR) AS event_type "
        "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
    ),
    "ev_l": (
        "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, um.user_idx, "
        "lpad(CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR), 10, '0') AS item_id, "
        "im.item_idx, "
        "CASE WHEN event_type = 'view' THEN 'add_to_cart' ELSE event_type END AS event_type, "
        "epoch_us(ts) / 1e6 AS \"timestamp\", 1 AS quantity FROM events "
        "LEFT JOIN user_map_l um ON um.customer_id = CAST(user_id AS VARCHAR) "
        "LEFT JOIN item_map_l im ON im.article_id = "
        "lpad(CAST(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS VARCHAR), 10, '0')"
    ),
    "user_map_l": (
        "SELECT customer_id, CAST(row_number() OVER (ORDER BY customer_id) - 1 AS INTEGER) AS user_idx "
        "FROM (SELECT DISTINCT customer_id FROM customers_l)"
    ),
    "item_map_l": (
        "SELECT article_id, CAST(row_number() OVER (ORDER BY article_id) - 1 AS INTEGER) AS item_idx "
        "FROM (SELECT DISTINCT article_id FROM articles_l)"
    ),
    # unit-normalised item vectors joined with the payload (zero stays zero)
    "index_l": (
        "SELECT m.item_idx, CAST(CASE WHEN e.nrm = 0 THEN e.ed "
        "ELSE list_transform(e.ed, lambda x: x / e.nrm) END AS FLOAT[]) AS v, "
        "coalesce(a.article_id, '') AS article_id, coalesce(a.prod_name, '') AS prod_name, "
        "coalesce(a.product_type_name, '') AS product_type_name, "
        "coalesce(a.product_group_name, '') AS product_group_name, "
        "coalesce(a.graphical_appearance_name, '') AS graphical_appearance_name, "
        "coalesce(a.index_group_name, '') AS index_group_name "
        "FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS ed, "
        "sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm "
        "FROM embeddings) e JOIN item_map_l m ON CAST(e.vec_id AS INTEGER) = m.item_idx "
        "LEFT JOIN articles_l a ON a.article_id = m.article_id"
    ),
}

# dependency order for emitting a WITH clause
ORDER = ["customers_l", "articles_l", "tx_l", "user_map_l", "item_map_l", "ev_l", "index_l"]


def cos_sql(a: str, b: str) -> str:
    """Cosine of two list columns in double precision, 0 for a zero norm."""
    da, db = f"CAST({a} AS DOUBLE[])", f"CAST({b} AS DOUBLE[])"
    na, nb = f"list_dot_product({da}, {da})", f"list_dot_product({db}, {db})"
    return (f"(CASE WHEN {na} = 0 OR {nb} = 0 THEN 0.0 ELSE "
            f"list_dot_product({da}, {db}) / (sqrt({na}) * sqrt({nb})) END)")


def with_views(*needed: str, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH clause holding the needed views (and their dependencies) plus
    ``extra`` (name, body) CTEs appended in order."""
    deps = {
        "ev_l": {"user_map_l", "item_map_l"},
        "user_map_l": {"customers_l"},
        "item_map_l": {"articles_l"},
        "index_l": {"item_map_l", "articles_l"},
    }
    want: set[str] = set()

    def add(n: str) -> None:
        if n in want:
            return
        want.add(n)
        for d in deps.get(n, ()):
            add(d)

    for n in needed:
        add(n)
    parts = [f"{n} AS ({VIEWS[n]})" for n in ORDER if n in want]
    parts += [f"{n} AS ({body})" for n, body in (extra or [])]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else ""
