"""Column-valued scalar helpers (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftrank import schema as S


def pad_id(col: Column | str, width: int = S.ID_WIDTH) -> Column:
    """int -> zero-padded string; null or non-numeric input stays null."""
    c = F.col(col) if isinstance(col, str) else col
    as_long = c.try_cast("bigint")
    return F.when(as_long.isNotNull(),
                  F.format_string(f"%0{width}d", as_long))


def event_weight(col: Column | str = "event_type",
                 weights: Mapping[str, float] = S.EVENT_WEIGHTS,
                 null_weight: float = S.NULL_EVENT_WEIGHT,
                 other: float = S.UNKNOWN_EVENT_WEIGHT) -> Column:
    """Weight of an event type: known types from ``weights``, null counts as a
    historical purchase, any other type 0."""
    c = F.col(col) if isinstance(col, str) else col
    expr = F.when(c.isNull(), F.lit(null_weight))
    for name, w in weights.items():
        expr = expr.when(c == name, F.lit(float(w)))
    return expr.otherwise(F.lit(float(other)))


def image_code(col: Column | str = "article_id") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.substring(c, 1, S.IMAGE_CODE_CHARS)


def item_metadata(article_id="article_id", name="prod_name",
                  group="product_group_name", type_="product_type_name") -> Column:
    """Display struct of an item (article_id, name, group, type, image_code)."""
    return F.struct(
        F.col(article_id).alias("article_id"),
        F.col(name).alias("name"),
        F.col(group).alias("group"),
        F.col(type_).alias("type"),
        image_code(article_id).alias("image_code"),
    )


def damped_rating(weight_sum: Column) -> Column:
    return F.log1p(weight_sum).cast("float")


def parse_csv_list(col: Column | str, as_int: bool = False) -> Column:
    """'a, b,,c' -> ['a','b','c'] (trimmed, blanks dropped); null -> [].

    With ``as_int`` each entry is try-cast to int and failures dropped.
    """
    c = F.col(col) if isinstance(col, str) else col
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)),
                     lambda x: x != "")
    if not as_int:
        return parts
    return F.filter(F.transform(parts, lambda x: x.try_cast("int")),
                    lambda x: x.isNotNull())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0.0 when either vector has zero norm."""
    na, nb = norm(a), norm(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def unit(a: Column, as_float: bool = True) -> Column:
    """Scale a vector to unit length; a zero vector stays zero."""
    n = norm(a)
    t = "float" if as_float else "double"
    return F.when(n == 0, F.transform(a, lambda x: x.cast(t))).otherwise(
        F.transform(a, lambda x: (x.cast("double") / n).cast(t)))
