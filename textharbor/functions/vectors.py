"""Vector arithmetic as Column expressions over ``array<float>``."""

from pyspark.sql import functions as F


def dot(left, right):
    """Inner product in double precision."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(vector):
    """Unit vector as ``array<float>``; a zero vector stays zero."""

    def scaled(length):
        unit = F.transform(vector, lambda x: (x.cast("double") / length).cast("float"))
        return F.when(length > 0, unit).otherwise(vector.cast("array<float>"))

    # The length is bound once per vector: inside the inner function it would be summed for every number.
    return F.get(F.transform(F.array(norm(vector)), scaled), 0)


def has_dim(vector, dim):
    """True for vectors of ``dim`` finite numbers; false, not NULL, for a NULL vector or number."""
    whole = (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(whole, F.lit(False))


def split_by_dim(df, vector, dim):
    """Rows with a usable vector, and the rejected rest."""
    ok = has_dim(F.col(vector), dim)
    return df.filter(ok), df.filter(~ok)


def cosine_to(df, vector, query_vector, out="score"):
    """Score every row against one query vector (a plain list of numbers)."""
    q = F.lit([float(x) for x in query_vector]).cast("array<float>")
    return df.withColumn(out, dot(l2_normalize(F.col(vector)), l2_normalize(q)))
