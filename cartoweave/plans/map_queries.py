"""Queries of views, quadtree keys, labels and densities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.functions import quad as Q
from cartoweave.operators import density as D
from cartoweave.operators import labels as L
from cartoweave.operators import peaks as K
from cartoweave.operators import views as V
from cartoweave.operators.density_query import density_query
from cartoweave.plans import base as B
from cartoweave.session import materialise, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a function as a query, with the SQL that states the same."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("select case when grouping(t) = 1 then 'total' else t end as doc_type, count(*) as n from (select coalesce(doc_type, 'unknown') as t from user_docs) group by rollup (t)")
def a01_doc_types(spark: SparkSession, d: str) -> DataFrame:
    """Documents per type and in all."""
    return V.doc_type_counts(table(spark, d, "user_docs"))


@query(f"with {B.TWEETS} select username, count(*) as n from tweets where doc_type = 'raw_tweet' group by username")
def a02_docs_per_user(spark: SparkSession, d: str) -> DataFrame:
    """Raw tweets per user."""
    return B.tweets(spark, d, "doc_type", "username").where("doc_type = 'raw_tweet'").groupBy("username").agg(F.count("*").alias("n"))


@query(f"with {B.TWEETS} select doc_type, count(*) as n from tweets group by doc_type")
def rel_p01_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Tweets by checked type."""
    return B.tweets(spark, d, "doc_type").select(V.checked_type().alias("doc_type")).groupBy("doc_type").agg(F.count("*").alias("n"))


@query("select distinct cast(tweet_id as varchar) as key, username, tweet_id as id, 'twitter' as provider_namespace, text, entities, 'raw_tweet' as doc_type, 'true' as from_csharp from raw_tweets where doc_type = 'csharp_munged_tweet'")
def rel_p02_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Reshaped tweets in the shape of raw ones."""
    return V.normalised_tweets(table(spark, d, "raw_tweets").where("doc_type = 'csharp_munged_tweet'"), "tweet_id", "username").distinct()


@query("select distinct username as screen_name, 'user' as doc_type, null::varchar as hash, null::varchar as coords from raw_tweets where username is not null and doc_type = 'csharp_munged_tweet'")
def rel_p03_users(spark: SparkSession, d: str) -> DataFrame:
    """A user document for every name of the reshaped tweets."""
    return V.distinct_users(table(spark, d, "raw_tweets").where("doc_type = 'csharp_munged_tweet'"), "username")


@query(f"with {B.POSITIONED} select token, x, y, count from positioned where token = 'injunction'")
def rel_p09_single_token(spark: SparkSession, d: str) -> DataFrame:
    """The rows of one token."""
    return V.single_token(B.positioned(spark, d), "injunction").select("token", "x", "y", "count")


@query(f"with {B.POSITIONED} select token, cast(sum(count) as bigint) as total from positioned where isfinite(x) and isfinite(y) and x > -80 and y < 0 group by token")
def rel_p15_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Token totals within bounds of which two are left open."""
    rows = B.positioned(spark, d).where(Q.within("x", "y", x_min=-80, y_max=0) & ~F.isnan("x") & ~F.isnan("y"))
    return V.summed(rows, ["token"], "count", "total")


@query(f"with {B.PEOPLE} select \"user\", x, y from people where {B.ON_MAP}")
def rel_p16_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Users on the map."""
    return B.people(spark, d).where(Q.on_map("x", "y"))


@query(f"with {B.POSITIONED}, pr as (select token, \"user\", count / sum(count) over (partition by \"user\") as p from positioned) select token, round(sum(p), 6) as total from pr group by token")
def a04_all_token(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the probabilities of every token."""
    return V.summed(_probable(spark, d), ["token"], "p", "total").withColumn("total", F.round("total", 6))


def _probable(spark: SparkSession, d: str) -> DataFrame:
    rows = B.positioned(spark, d)
    return rows.join(rows.groupBy("user").agg(F.sum("count").alias("n")), "user").withColumn("p", F.col("count") / F.col("n"))


_PROBABLE = f"with {B.POSITIONED}, pr as (select token, \"user\", x, y, count, count / sum(count) over (partition by \"user\") as p from positioned)"


@query(_PROBABLE + " select token, \"user\", round(sum(p), 6) as total from pr group by all")
def a05_user_by_token(spark: SparkSession, d: str) -> DataFrame:
    """Sum of the probabilities by token and user."""
    return V.summed(_probable(spark, d), ["token", "user"], "p", "total").withColumn("total", F.round("total", 6))


_SQUARES = _PROBABLE + ", sq as (select try_cast(floor(x + 0.5) as bigint) as x, try_cast(floor(y + 0.5) as bigint) as y, token, sum(p) as value from pr where isfinite(x) and isfinite(y) group by all)"


def _squares(spark: SparkSession, d: str) -> DataFrame:
    return V.token_per_square(_probable(spark, d).where("x is not null and y is not null and not isnan(x) and not isnan(y)"), "p")


@query(_SQUARES + " select x, y, token, round(value, 6) as value from sq")
def a14_square(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities by square and token."""
    return _squares(spark, d).withColumn("value", F.round("value", 6))


@query(_SQUARES + " select x, y, token, value from (select x, y, token, round(value, 6) as value from sq) qualify row_number() over (partition by x, y order by value desc, token desc) = 1")
def w04_top_token(spark: SparkSession, d: str) -> DataFrame:
    """The top token of every square."""
    return V.top_by(a14_square(spark, d), ["x", "y"], "value", ["token"])


@query(_SQUARES + " select x, y, token, value from (select x, y, token, round(value, 6) as value from sq) qualify row_number() over (partition by token order by value desc, x desc, y desc) = 1")
def w05_top_square(spark: SparkSession, d: str) -> DataFrame:
    """The top square of every token."""
    return V.top_by(a14_square(spark, d), ["token"], "value", ["x", "y"])


@query(f"with {B.POSITIONED} select token, x, y, cast(sum(count) as bigint) as n from positioned group by all")
def a16_location_by_token(spark: SparkSession, d: str) -> DataFrame:
    """Counts by token and place."""
    return V.summed(B.positioned(spark, d), ["token", "x", "y"], "count", "n")


@query(f"with {B.PEOPLE}, k as (select \"user\", {B.QUAD} as q from people where {B.ON_MAP}) select \"user\", array_to_string(q, ',') as quadkey from k")
def f17_quadkey(spark: SparkSession, d: str) -> DataFrame:
    """the key of every user on the map."""
    return V.with_quadkey(B.people(spark, d)).select("user", Q.key_text("quadkey").alias("quadkey"))


_DECODED = f"with {B.PEOPLE}, k as (select \"user\", {B.QUAD} as q from people where {B.ON_MAP})"


@query(_DECODED + " select \"user\", cast(list_reduce(list_prepend(0, list_transform(q, lambda v: v & 1)), lambda a, v: a * 2 + v) as bigint) as x, cast(list_reduce(list_prepend(0, list_transform(q, lambda v: v >> 1)), lambda a, v: a * 2 + v) as bigint) as y from k")
def f16_quad_to_xy(spark: SparkSession, d: str) -> DataFrame:
    """F16: cell numbers of every user's key."""
    return V.with_quadkey(B.people(spark, d)).select("user", Q.quad_to_xy("quadkey").alias("c")).select("user", "c.x", "c.y")


@query(_DECODED + ", c as (select \"user\", cast(list_reduce(list_prepend(0, list_transform(q[:9], lambda v: v & 1)), lambda a, v: a * 2 + v) as bigint) as x, cast(list_reduce(list_prepend(0, list_transform(q[:9], lambda v: v >> 1)), lambda a, v: a * 2 + v) as bigint) as y from k) select \"user\", (2 * x + 1) * 64 as x, (2 * y + 1) * 64 as y, cast(9 as bigint) as precision from c")
def f19_decode(spark: SparkSession, d: str) -> DataFrame:
    """centres of the cells of nine digits."""
    return V.with_quadkey(B.people(spark, d)).select("user", Q.decode_point(Q.prefix("quadkey", 9)).alias("c")).select("user", "c.x", "c.y", "c.precision")


@query(f"with {B.PEOPLE}, p as (select \"user\", try_cast(trunc((x + 104) * 204.8) as bigint) as xi, try_cast(trunc((y + 104) * 204.8) as bigint) as yi from people where {B.ON_MAP}) select \"user\", array_to_string(list_transform(range(14, -1, -1), lambda i: 2 * (((yi >> 1) >> i) & 1) + (((xi >> 1) >> i) & 1)), ',') as quadkey from p")
def f18_encode(spark: SparkSession, d: str) -> DataFrame:
    """keys of points of the twice as fine grid."""
    at = lambda c: ((F.col(c) + 104) * 204.8).cast("bigint")
    return B.people(spark, d).where(Q.on_map("x", "y")).select("user", Q.key_text(Q.encode_point(at("x"), at("y"))).alias("quadkey"))


_DENSITY = f"with {B.POSITIONED}, td as (select token, array_to_string({B.QUAD}, ',') as cell, {B.QUAD} as q, count from positioned where {B.ON_MAP})"


@query(_DENSITY + " select token, cell as quadkey, cast(sum(count) as bigint) as value from td group by all")
def a12_token_density(spark: SparkSession, d: str) -> DataFrame:
    """Counts by token and cell of fifteen digits."""
    return V.token_density(B.positioned(spark, d)).select("token", Q.key_text("quadkey").alias("quadkey"), "value")


@query(_DENSITY + " select token, array_to_string(q[:6], ',') as quadkey, cast(sum(count) as bigint) as value from td group by all")
def a11_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Token densities rolled up to six digits."""
    return V.roll_up(V.token_density(B.positioned(spark, d)), 6, ["token"]).select("token", Q.key_text("quadkey").alias("quadkey"), "value")


@query(_DECODED + " select array_to_string(q[:9], ',') as quadkey, count(*) as value from k group by all")
def a13_locations(spark: SparkSession, d: str) -> DataFrame:
    """Users by cell of nine digits."""
    return V.locations(B.people(spark, d), 9).select(Q.key_text("quadkey").alias("quadkey"), "value")


_ROWS = f"with {B.POSITIONED}, td as (select token, array_to_string(({B.QUAD})[:5], ',') as cell, count from positioned where {B.ON_MAP}), rows_ as (select token, cell, cast(sum(count) as bigint) as value from td group by all), tot as (select token, cell, value, cast(sum(value) over (partition by token) as bigint) as total from rows_), top as (select token, cell, value, total, row_number() over (partition by cell order by value desc, total desc, token desc) as place from tot)"


def _rows(spark: SparkSession, d: str, digits: int = 5) -> DataFrame:
    return V.token_density(B.positioned(spark, d), digits).select("token", Q.key_text("quadkey").alias("cell"), "value")


@query(_ROWS + " select token, cell, value from rows_")
def s08_view_rows(spark: SparkSession, d: str) -> DataFrame:
    """View rows written as lines and read again."""
    return L.parsed_rows(L.view_line(_rows(spark, d), True), True)


@query(_ROWS + " select token, cell, value, total from tot")
def a18_with_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the totals of their tokens."""
    return L.with_totals(_rows(spark, d)).select("token", "cell", "value", "total")


@query(_ROWS + " select token, cell, value, total, place from top where place <= 10")
def w01_top_tokens_cell(spark: SparkSession, d: str) -> DataFrame:
    """The first ten tokens of every cell."""
    return L.top_tokens(_rows(spark, d)).select("token", "cell", "value", "total", F.col("place").cast("long").alias("place"))


@query(_ROWS + " select token, cell, value, total from tot qualify value = max(value) over (partition by token)")
def w02_argmax_cells(spark: SparkSession, d: str) -> DataFrame:
    """The best cells of every token."""
    return L.best_cells(_rows(spark, d)).select("token", "cell", "value", "total")


@query(_ROWS + " select cell, token, cast(trunc(10000.0::double * value / total) as bigint) as value from top where place <= 10")
def f21_relative_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by share of the token's total."""
    return L.location_labels(_rows(spark, d), "relative")


@query(_ROWS + " select cell, token, cast(trunc(10000.0::double * value / total * (4 + ln(total))) as bigint) as value from top where place <= 10")
def f21_adjusted_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by share adjusted for popularity."""
    return L.location_labels(_rows(spark, d), "adjusted")


_BEST = _ROWS + ", best as (select token, cell, value, total from tot qualify value = max(value) over (partition by token))"


@query(_BEST + " select cell, token, value from (select cell, token, cast(trunc(value * (1000.0::double / total)) as bigint) as value from best) qualify row_number() over (partition by cell order by value desc, token desc) <= 100")
def f22_token_relative(spark: SparkSession, d: str) -> DataFrame:
    """Tokens at their best cells, per mille of their total."""
    return L.token_labels(_rows(spark, d), "token_relative")


@query(_BEST + " select cell, token, value from best qualify row_number() over (partition by cell order by value desc, token desc) <= 100")
def w03_token_total(spark: SparkSession, d: str) -> DataFrame:
    """Tokens at their best cells."""
    return L.token_labels(_rows(spark, d), "token_total")


_MAGIC = _BEST + """, here as (select cell, token, value from top where place <= 10), there as (select cell, token, value from best where cell in (select cell from here) qualify row_number() over (partition by cell order by value desc, token desc) <= 10),
both_ as (select cell, token, cast(sum(value) as bigint) as value from (select * from here union all select * from there) group by all),
less as (select cell, token, case when octet_length(encode(token)) > 8 then value * 8 // octet_length(encode(token)) else value end as value from both_),
pen as (select cell, token, case when starts_with(token, '@') or starts_with(token, 'http://') then value // 10 else value end as value from less),
magic as (select cell, token, value from pen where value > 0 qualify row_number() over (partition by cell order by value desc, token desc) <= 20)"""


@query(_MAGIC + " select cell, token, value from magic")
def f23_magic_labels(spark: SparkSession, d: str) -> DataFrame:
    """The combined labels."""
    return L.magic_labels(_rows(spark, d))


@query(_MAGIC + f""", users as (select array_to_string(({B.QUAD})[:5], ',') as cell, count(*) as users from people where {B.ON_MAP} group by all), per as (select cell, count(*) as labels from magic group by cell)
select cell, coalesce(labels, 0) as labels, users.users from per full join users using (cell)""")
def j07_cells_users(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their numbers of labels and users."""
    users = V.locations(B.people(spark, d), 5).select(Q.key_text("quadkey").alias("cell"), "value")
    return L.with_users(L.magic_labels(_rows(spark, d)), users)


@query(_MAGIC + f""", users as (select array_to_string(({B.QUAD})[:5], ',') as cell, count(*) as users from people where {B.ON_MAP} group by all), per as (select cell, string_agg(token || ':' || value, ' ' order by value desc, token desc) as labels from magic group by cell),
joined as (select cell, labels, users.users from per full join users using (cell)), q as (select *, string_split(cell, ',')::int[] as d from joined)
select cell, cast(list_reduce(list_prepend(0, list_transform(d, lambda v: v & 1)), lambda a, v: a * 2 + v) as int) as x, cast(list_reduce(list_prepend(0, list_transform(d, lambda v: v >> 1)), lambda a, v: a * 2 + v) as int) as y, users, labels from q""")
def s11_cell_frame(spark: SparkSession, d: str) -> DataFrame:
    """The frame behind a table of cells: place, users and ranked labels."""
    users = V.locations(B.people(spark, d), 5).select(Q.key_text("quadkey").alias("cell"), "value")
    made = L.cell_frame(L.magic_labels(_rows(spark, d)), users)
    text = F.array_join(F.transform("labels", lambda t: F.concat(t["token"], F.lit(":"), t["value"].cast("string"))), " ")
    return made.select("cell", "x", "y", "users", F.when(F.col("labels").isNotNull(), text).alias("labels"))


@query(_MAGIC + """, xy as (select cell, token, list_reduce(list_prepend(0, list_transform(string_split(cell, ','), lambda v: v::int & 1)), lambda a, v: a * 2 + v) as x, list_reduce(list_prepend(0, list_transform(string_split(cell, ','), lambda v: v::int >> 1)), lambda a, v: a * 2 + v) as y from magic),
l as (select distinct a.cell, b.cell as other from xy a join xy b on a.token = b.token and b.x = a.x - 1 and b.y = a.y), u as (select distinct a.cell, b.cell as other from xy a join xy b on a.token = b.token and b.x = a.x and b.y = a.y - 1)
select cell, 'left' as side from l union select other, 'right' from l union select cell, 'up' from u union select other, 'down' from u""")
def j09_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Sides on which neighbouring cells share labels."""
    return L.neighbour_classes(materialise(L.magic_labels(_rows(spark, d))))


@query(f"with {B.POSITIONED}, t as (select token, cast(sum(count) as bigint) as count from positioned group by token) select token, count from t where count >= 150 and not starts_with(token, '@') and not starts_with(token, 'http') and length(token) <= 15")
def rel_p17_label_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that may become labels."""
    return K.label_candidates(V.summed(B.positioned(spark, d), ["token"], "count", "count"))


@query(_ROWS + " select token, cell, value from rows_ where pow(ln(value::double), 2) * 0.02 * (1.4 + 60) >= 8")
def rel_p18_visible(spark: SparkSession, d: str) -> DataFrame:
    """Rows large enough to be drawn at a zoom."""
    return D.visible_labels(_rows(spark, d), 60)


WIDTH = HEIGHT = 96
WHOLE = D.Frame(-104.0, -104.0, WIDTH / 160, HEIGHT / 160, WIDTH, HEIGHT)
KERNEL = -0.05
_SIDE = D.kernel(KERNEL)
_OFFSETS = ", ".join(f"({d}, {_SIDE[abs(d)]!r}::double)" for d in range(1 - len(_SIDE), len(_SIDE)))


def _fuzz(name: str, points: str, low: str = "104", scale: str = "0.6", offsets: str = _OFFSETS) -> str:
    return f""", at_{name} as (select try_cast(trunc((x + {low}) * {scale}) as int) as gx, try_cast(trunc((y + {low}) * {scale}) as int) as gy, sum(v)::double as v from {points} group by all),
tall_{name} as (select gx, gy + o.d as gy, sum(v * o.f) as v from at_{name}, (values {offsets}) o(d, f) where gy + o.d between 0 and {HEIGHT - 1} group by all having sum(v * o.f) >= 0.001),
{name} as (select gx + o.d as gx, gy, sum(v * o.f) as v from tall_{name}, (values {offsets}) o(d, f) where gx + o.d between 0 and {WIDTH - 1} group by all)"""


_POINTS = f"with {B.POSITIONED}, pts as (select token, x, y, count as v from positioned where {B.ON_MAP}), pa as (select * from pts where token = 'injunction'), pb as (select * from pts where token = 'diagnosis')"
_GRIDS = _POINTS + _fuzz("a", "pa") + _fuzz("b", "pb")


def _points(spark: SparkSession, d: str) -> DataFrame:
    return B.positioned(spark, d).where(Q.on_map("x", "y")).select("token", "x", "y", F.col("count").alias("v"))


def _named(spark: SparkSession, d: str) -> DataFrame:
    """Points under names as the query language spells them."""
    from cartoweave.functions.text import normalise_token

    return materialise(_points(spark, d).withColumn("token", normalise_token("token")))


def _rounded(grid: DataFrame) -> DataFrame:
    return grid.select("gx", "gy", F.round("v", 6).alias("v"))


@query(f"with {B.PEOPLE}, pp as (select x, y, 1 as v from people where {B.ON_MAP})" + _fuzz("g", "pp") + " select gx, gy, round(v, 6) as v from g")
def g02_density(spark: SparkSession, d: str) -> DataFrame:
    """Density of all users."""
    return _rounded(D.density(B.people(spark, d).where(Q.on_map("x", "y")).withColumn("v", F.lit(1)), WHOLE, KERNEL))


_WIDE = D.kernel(KERNEL / 4)
_WIDE_OFFSETS = ", ".join(f"({d}, {_WIDE[abs(d)]!r}::double)" for d in range(1 - len(_WIDE), len(_WIDE)))


@query(f"with {B.PEOPLE}, pp as (select x, y, 1 as v from people where {B.ON_MAP})" + _fuzz("g", "pp", "100", "1.2", _WIDE_OFFSETS) + " select gx, gy, round(v, 6) as v from g")
def g03_zoomed(spark: SparkSession, d: str) -> DataFrame:
    """Density of a quarter of the map."""
    return _rounded(D.zoomed_density(B.people(spark, d).where(Q.on_map("x", "y")).withColumn("v", F.lit(1)), WHOLE, 1, -60.0, -60.0, WIDTH, HEIGHT, KERNEL))


@query(_GRIDS + " select gx, gy, round(a.v * b.v, 6) as v from a join b using (gx, gy)")
def g05_density_mul(spark: SparkSession, d: str) -> DataFrame:
    """Product of two densities, as a query text."""
    return _rounded(density_query("injunction diagnosis", _named(spark, d), WHOLE, KERNEL))


@query(_GRIDS + " select gx, gy, round(coalesce(a.v, 0) + coalesce(b.v, 0), 6) as v from a full join b using (gx, gy)")
def g05_density_add(spark: SparkSession, d: str) -> DataFrame:
    """Sum of two densities."""
    return _rounded(density_query("injunction + diagnosis", _named(spark, d), WHOLE, KERNEL))


@query(_GRIDS + " select gx, gy, round(greatest(0, coalesce(a.v, 0) - coalesce(b.v, 0)), 6) as v from a full join b using (gx, gy)")
def g05_density_sub(spark: SparkSession, d: str) -> DataFrame:
    """What one density has more than another."""
    return _rounded(density_query("injunction - diagnosis", _named(spark, d), WHOLE, KERNEL))


@query(_GRIDS + " select gx, gy, round(abs(coalesce(a.v, 0) - coalesce(b.v, 0)), 6) as v from a full join b using (gx, gy)")
def g05_density_diff(spark: SparkSession, d: str) -> DataFrame:
    """Absolute difference of two densities."""
    return _rounded(density_query("injunction ^ diagnosis", _named(spark, d), WHOLE, KERNEL))


@query(_GRIDS + " select gx, gy, round(greatest(0, v - (select avg(v) from a where v <> 0)), 6) as v from a")
def g04_gate(spark: SparkSession, d: str) -> DataFrame:
    """A density above its mean."""
    return _rounded(density_query("\\ injunction", _named(spark, d), WHOLE, KERNEL))


@query(_GRIDS + f" select cast(c.gx as int) as gx, cast(c.gy as int) as gy, round(ln(pow(1.01, coalesce(a.v, 0))), 6) as v from (select x.r as gx, y.r as gy from range({WIDTH}) x(r), range({HEIGHT}) y(r)) c left join a on a.gx = c.gx and a.gy = c.gy")
def g04_exp(spark: SparkSession, d: str) -> DataFrame:
    """1.01 to the power of a density, over the whole picture, and its logarithm again."""
    return _rounded(D.unary(density_query("^ injunction", _named(spark, d), WHOLE, KERNEL), "~", WIDTH, HEIGHT))


@query(_GRIDS + " select gx, gy, round(sqrt(v), 6) as v from a")
def g04_sqrt(spark: SparkSession, d: str) -> DataFrame:
    """Square root of a density."""
    return _rounded(density_query("` injunction", _named(spark, d), WHOLE, KERNEL))


@query(_POINTS + ", pt as (select * from pa order by v desc, x, y limit 20)" + _fuzz("g", "pt") + " select gx, gy, round(v, 6) as v from g")
def g06_top_n(spark: SparkSession, d: str) -> DataFrame:
    """Density of the twenty largest points."""
    return _rounded(density_query(">20 injunction", _named(spark, d), WHOLE, KERNEL))


@query(_POINTS + " select min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, max(v) as max_value from pts")
def a31_extrema(spark: SparkSession, d: str) -> DataFrame:
    """Extrema of the points."""
    return D.extrema(_points(spark, d))


@query(_GRIDS + ", m as (select max(v) as most from a) select gx, gy, cast(trunc(least(floor(v * (99.9::double / most)), 99)::double * 255.0 / 100) as bigint) as height from a, m")
def f36_height_scale(spark: SparkSession, d: str) -> DataFrame:
    """linear heights of a density."""
    grid = materialise(density_query("injunction", _named(spark, d), WHOLE, KERNEL))
    most = grid.agg(F.max("v")).first()[0] or 1.0
    return grid.select("gx", "gy", D.height_scale(F.col("v"), most, "linear", 100, 255.0).alias("height"))


@query(f"""with {B.PEOPLE}, p as (select x, y from people where {B.ON_MAP}), s as (select count(*) as n, min(x) * 1.2 as x0, max(x) * 1.2 as x1, min(y) * 1.2 as y0, max(y) * 1.2 as y1, pow(count(*), -1.0 / 3) as f, covar_samp(x, x) as xx, covar_samp(x, y) as xy, covar_samp(y, y) as yy from p),
k as (select *, (xx * yy - xy * xy) * f * f as det from s), c as (select a.r as gx, b.r as gy from range(100) a(r), range(100) b(r)),
g as (select gx, gy, x0 + gx * (x1 - x0) / 99 as cx, y0 + gy * (y1 - y0) / 99 as cy, k.* from c, k)
select cast(gx as int) as gx, cast(gy as int) as gy, round(sum(exp(-0.5 * (pow(cx - x, 2) * yy * f - 2 * (cx - x) * (cy - y) * xy * f + pow(cy - y, 2) * xx * f) / det)) / (any_value(n) * 2 * pi() * sqrt(any_value(det))), 7) as v from g, p group by gx, gy""")
def g08_kde(spark: SparkSession, d: str) -> DataFrame:
    """Kernel density of the users on 100 x 100 places."""
    return D.kde(B.people(spark, d).where(Q.on_map("x", "y"))).select("gx", "gy", F.round("v", 7).alias("v"))


def _token_grids(spark: SparkSession, d: str) -> DataFrame:
    points = _points(spark, d)
    totals = points.groupBy("token").agg(F.sum("v").cast("double").alias("count"))
    px, py = WHOLE.pixel(F.col("x"), F.col("y"))
    cells = points.groupBy("token", px.alias("gx"), py.alias("gy")).agg(F.sum("v").cast("double").alias("v"))
    side = F.array(*[F.struct(F.lit(i).alias("d"), F.lit(_SIDE[abs(i)]).alias("f")) for i in range(1 - len(_SIDE), len(_SIDE))])
    for axis, size in (("gy", HEIGHT), ("gx", WIDTH)):
        moved = cells.select("*", F.explode(side).alias("o")).withColumn(axis, F.col(axis) + F.col("o.d")).withColumn("v", F.col("v") * F.col("o.f"))
        cells = moved.where((F.col(axis) >= 0) & (F.col(axis) < size)).groupBy("token", "gx", "gy").agg(F.sum("v").alias("v"))
    return cells.join(totals, "token")


@query()
def g11_peaks_climb(spark: SparkSession, d: str) -> DataFrame:
    """Blended peaks of every token by steepest ascent."""
    return K.token_peaks(_token_grids(spark, d), WIDTH, HEIGHT, "climb")


@query()
def g10_peaks_descend(spark: SparkSession, d: str) -> DataFrame:
    """Blended peaks of every token by flooding."""
    return K.token_peaks(_token_grids(spark, d), WIDTH, HEIGHT, "descend")


@query()
def o09_labels(spark: SparkSession, d: str) -> DataFrame:
    """The labels of every token's peaks, winnowed."""
    peaks = K.token_peaks(_token_grids(spark, d), WIDTH, HEIGHT, "climb")
    labels = materialise(K.token_labels(peaks, significant=0.0))
    pixels = D.Frame(0.0, 0.0, 1.0, 1.0, WIDTH, HEIGHT)
    local = D.density(labels.select("x", "y", F.col("significance").alias("v")), pixels, KERNEL)
    return K.winnowed(labels, local, 1000)


_NEAR = ", ".join(f"({ox}, {oy}, {ox * (2 - abs(oy))}, {-oy * (2 - abs(ox))})" for ox in (-1, 0, 1) for oy in (-1, 0, 1) if ox or oy)


@query(_GRIDS + f", sl as (select gx + ox as gx, gy + oy as gy, sum(v * wx) * 0.01::double as dx, sum(v * wy) * 0.01::double as dy from a, (values {_NEAR}) o(ox, oy, wx, wy) group by all) select gx, gy, round(greatest((sin(0.9::double) + cos(0.9::double) * (dy * cos(2.5::double - pi() / 2) + dx * sin(2.5::double - pi() / 2))) / sqrt(1 + dx * dx + dy * dy), 0), 6) as v from sl")
def f35_hill_shade(spark: SparkSession, d: str) -> DataFrame:
    """light on the slopes of a density."""
    return _rounded(D.hill_shade(density_query("injunction", _named(spark, d), WHOLE, KERNEL), 0.01, 2.5, 0.9))
