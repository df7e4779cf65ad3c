"""The same results in DuckDB SQL, written from the definitions and not from the Spark plans."""

from __future__ import annotations

from tastemesh.functions.text import ENGLISH_STOP_WORDS

ASKING = "user_id % 100 = 0"


def _q(x: str, digits: int) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.5) / 1e{digits})"


def _norm(x: str) -> str:
    return f"nullif(nullif(replace(trim({x}), '.0', ''), ''), 'nan')"


_PAD = """case when coalesce("imdbId", '') = '' then ''
    when length(ltrim("imdbId", 't')) >= 7 then 'tt' || ltrim("imdbId", 't')
    else 'tt' || lpad(ltrim("imdbId", 't'), 7, '0') end"""

# Views of the tables.
VIEWS = f"""
sales as (select o_custkey, l_partkey, l_quantity from lineitem join orders on l_orderkey = o_orderkey),
ratings as (select o_custkey as "userId", l_partkey as "movieId", cast(ceil(l_quantity / 10) as double) as rating
    from sales),
raw_ratings as (select o_custkey as "userId", l_partkey as "movieId", l_quantity / 5.0 - 1.0 as rating from sales),
links as (select p_partkey as "movieId", cast(p_partkey * 50000 + 1 as varchar) as "imdbId",
    case p_size when 50 then null when 49 then 'nan' when 48 then ''
        else ' ' || cast(p_partkey as varchar) || '.0 ' end as "tmdbId" from part),
movie as (select p_partkey as id, p_name as title, 'tt' || cast(p_partkey * 50000 + 1 as varchar) as imdb_id,
    case when p_size <> 47 then cast(case when p_size <= 6 then p_partkey - p_partkey % 3 + 1 else p_partkey end as varchar)
        || '.0' end as tmdb_id, p_name as plot,
    p_type, p_brand from part),
history as (select "userId", {_PAD} as "imdbId", coalesce("tmdbId", '') as "tmdbId",
    greatest(0.0, least(5.0, rating)) as rating from raw_ratings join links using ("movieId")),
catalog as (select id, title, imdb_id, {_norm('tmdb_id')} as tmdb_id from movie),
firsts as (select * from catalog where tmdb_id is not null
    qualify row_number() over (partition by tmdb_id order by title nulls last, id) = 1),
usable as (select "userId" as user_id, {_norm('"tmdbId"')} as item_id, rating from history),
base as (select * from usable where item_id in (select tmdb_id from catalog where tmdb_id is not null)),
clean as (select * from base
    where user_id in (select user_id from base group by 1 having count(*) >= 20)
    and item_id in (select item_id from base group by 1 having count(*) >= 20)),
cells as (select user_id, item_id, {_q('sum(rating)', 9)} as rating, cast(count(*) as double) as seen from clean group by 1, 2)
"""

# Ratings count in units of 1e-4, so all moments are whole numbers. Constant raters have no correlation.
_PEARSON = """least(1.0, greatest(-1.0, cast(n_common * sxy - sx * sy as double)
    / sqrt(cast(n_common * sxx - sx * sx as double) * cast(n_common * syy - sy * sy as double))))"""
_DEFINED = "n_common >= 2 and lo_x < hi_x and lo_y < hi_y"


def _collaborative(user: int | str | None = None, k: int | None = 50) -> str:
    """Similarities, neighbours and predictions, for one user, for those of a condition, or for all."""
    one = "" if user is None else f"and a.{user}" if isinstance(user, str) else f"and a.user_id = {user}"
    cut = "" if k is None else f"where rank <= {k}"
    return VIEWS + f""",
means as (select user_id, avg(rating) as mean from cells group by 1),
norms as (select user_id, sum(seen * seen) as norm from cells group by 1),
units as (select user_id, item_id, cast(round(rating * 10000) as bigint) as x from cells where rating > 0),
moments as (select a.user_id, b.user_id as other_id, count(*) as n_common, sum(a.x) as sx, sum(b.x) as sy,
        sum(a.x * a.x) as sxx, sum(b.x * b.x) as syy, sum(a.x * b.x) as sxy,
        min(a.x) as lo_x, max(a.x) as hi_x, min(b.x) as lo_y, max(b.x) as hi_y
    from units a join units b on a.item_id = b.item_id and a.user_id <> b.user_id where true {one} group by 1, 2),
pearson as (select user_id, other_id, {_q(_PEARSON, 12)} as sim, n_common from moments where {_DEFINED}),
dots as (select a.user_id, b.user_id as other_id, count(*) as n_common, sum(a.seen * b.seen) as dot
    from cells a join cells b on a.item_id = b.item_id and a.user_id <> b.user_id where true {one} group by 1, 2),
cosine as (select d.user_id, other_id, {_q('dot / sqrt(x.norm * y.norm)', 12)} as sim, n_common
    from dots d join norms x on x.user_id = d.user_id join norms y on y.user_id = d.other_id),
pearson_nb as (select * from (select *,
    cast(row_number() over (partition by user_id order by abs(sim) desc, other_id) as int) as rank from pearson) {cut}),
cosine_nb as (select * from (select *,
    cast(row_number() over (partition by user_id order by sim desc, other_id) as int) as rank from cosine) {cut}),
pearson_sums as (select nb.user_id, c.item_id,
        sum(sim * (c.rating - m.mean)) as num, sum(abs(sim)) as den
    from pearson_nb nb join cells c on c.user_id = nb.other_id join means m on m.user_id = nb.other_id
    where c.rating <> 0 group by 1, 2),
cosine_sums as (select nb.user_id, c.item_id, sum(sim * c.seen) as num, sum(abs(sim)) as den
    from cosine_nb nb join cells c on c.user_id = nb.other_id group by 1, 2),
pearson_open as (select * from pearson_sums s where den > 0 and not exists
    (select 1 from cells c where c.user_id = s.user_id and c.item_id = s.item_id)),
cosine_open as (select * from cosine_sums s where den > 0 and not exists
    (select 1 from cells c where c.user_id = s.user_id and c.item_id = s.item_id))
"""


def _scores(which: str, digits: int, clipped: bool) -> str:
    ratio = "num / den"
    if which == "pearson":
        ratio = f"mean + {ratio}"
        if clipped:
            ratio = f"greatest(0.0, least(5.0, {ratio}))"
    means = "join means using (user_id)" if which == "pearson" else ""
    return f"""select user_id, item_id, {_q(_q(ratio, 10), digits)} as score, {_q(_q('den', 10), 4)} as support
        from {which}_open {means}"""


def _ranked(which: str, digits: int = 4, clipped: bool = True) -> str:
    return f"""select *, cast(row_number() over (partition by user_id order by score desc, item_id) as int) as rank
        from ({_scores(which, digits, clipped)})"""


def _recs(which: str, top_k: int) -> str:
    return f"""select user_id, rank, case when f.id is null then '?' else title end as title, item_id as tmdb_id,
        case when f.id is null then '?' else imdb_id end as imdb_id, score, support
        from ({_ranked(which)}) r left join firsts f on f.tmdb_id = r.item_id where rank <= {top_k}"""


_BOTH = f"""with {_collaborative(10)},
p as ({_recs('pearson', 500)}), c as ({_recs('cosine', 500)})
"""

_STOPS = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)


def _vectors(source: str, top: int = 5000) -> str:
    """TF-IDF vectors of ``source`` (item_id, text)."""
    return f"""
toks as (select item_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda w: w not in ({_STOPS})) as toks from {source}),
words as (select item_id, unnest(toks) as w1, generate_subscripts(toks, 1) as pos from toks),
runs as (select item_id, w1, lead(w1, 1) over o as w2, lead(w1, 2) over o as w3 from words
    window o as (partition by item_id order by pos)),
grams as (select item_id, w1 as term from runs union all select item_id, w1 || ' ' || w2 from runs where w2 is not null
    union all select item_id, w1 || ' ' || w2 || ' ' || w3 from runs where w3 is not null),
tf_all as (select item_id, term, count(*) as tf from grams group by 1, 2),
vocab as (select term, cast(sum(tf) as bigint) as total, count(*) as df from tf_all group by 1
    order by total desc, term limit {top}),
weighted as (select item_id, term, tf * (ln((1.0 + (select count(*) from {source})) / (df + 1)) + 1) as w
    from tf_all join vocab using (term)),
vectors as (select item_id, term, {_q('w / norm', 8)} as weight from weighted
    join (select item_id, sqrt(sum(w * w)) as norm from weighted group by 1) using (item_id))
"""


_TEXTS = "texts as (select doc_id as item_id, text from documents),"
_ITEM_TEXT = """item_texts as (select id as item_id, trim(coalesce(plot, '') || ' ' || p_type || ' ' || p_brand) as text
    from movie)"""

CONTENT = VIEWS + "," + _ITEM_TEXT + "," + _vectors("item_texts") + f""",
matches as (select u.user_id, f.id as item_id from usable u join firsts f on f.tmdb_id = u.item_id),
profile as (select user_id, term, sum(cast(floor(weight * 1e8 + 0.5) as bigint)) / 1e8 / any_value(n) as weight
    from matches join vectors using (item_id)
    join (select user_id, count(*) as n from matches group by 1) using (user_id) group by 1, 2),
item_norm as (select item_id, sqrt(sum(weight * weight)) as inorm from vectors group by 1),
user_norm as (select user_id, sqrt(sum(weight * weight)) as unorm from profile group by 1),
dotted as (select p.user_id, v.item_id, sum(p.weight * v.weight) as dot from vectors v join profile p using (term)
    group by 1, 2),
cosines as (select user_id, item_id, {_q('dot / (inorm * unorm)', 9)} as score
    from dotted join item_norm using (item_id) join user_norm using (user_id)),
table_all as (select u.user_id, m.id as item_id, m.title, s.user_id is not null as seen,
        case when s.user_id is null then coalesce(score, 0.0) end as score
    from (select distinct user_id from matches) u cross join movie m
    left join cosines c on c.user_id = u.user_id and c.item_id = m.id
    left join (select distinct user_id, item_id from matches) s on s.user_id = u.user_id and s.item_id = m.id)
"""


def _content_recs(where: str, top_k: int) -> str:
    return f"""with {CONTENT} select user_id, rank, title, tmdb_id, imdb_id, {_q('score', 4)} as score, item_id from (
        select t.*, c.tmdb_id, c.imdb_id, cast(row_number() over (partition by user_id
            order by score desc, t.title nulls last, item_id) as int) as rank
        from table_all t join catalog c on c.id = t.item_id where not seen and {where}) where rank <= {top_k}"""


_VECTOR_ROWS = f"select item_id, term, {_q('weight', 6)} as weight from vectors"

ORACLE: dict[str, str] = {
    "csv_catalog_roundtrip": f"""with {VIEWS} select id, title, imdb_id, tmdb_id, plot, p_type as genres,
        p_brand as themes from movie""",
    "csv_ratings_roundtrip": f"with {VIEWS} select * from ratings",
    "csv_links_roundtrip": f"with {VIEWS} select * from links",
    "csv_history_roundtrip": f"with {VIEWS} select * from history",
    "parquet_catalog_roundtrip": f"""with {VIEWS} select id, title, imdb_id, tmdb_id, plot, p_type as genres,
        p_brand as themes from movie""",
    "vector_store_roundtrip": f"with {VIEWS}, {_ITEM_TEXT}, {_vectors('item_texts')} {_VECTOR_ROWS}",
    "normalize_id": f"""with {VIEWS} select "movieId", {_norm('"tmdbId"')} as tmdb_id from links""",
    "pad_imdb_id": f"""with {VIEWS} select "movieId", {_PAD} as imdb_id from links""",
    "clip_rating": f"""with {VIEWS} select "userId", "movieId", rating,
        case when rating is not null then greatest(0.0, least(5.0, rating)) end as clipped from raw_ratings""",
    "export_history": f"""with {VIEWS} select "userId", {_PAD} as "imdbId", coalesce("tmdbId", '') as "tmdbId"
        from raw_ratings join links using ("movieId")""",
    "export_history_rated": f"""with {VIEWS} select "userId", {_PAD} as "imdbId", coalesce("tmdbId", '') as "tmdbId",
        greatest(0.0, least(5.0, rating)) as rating from raw_ratings join links using ("movieId")""",
    "clean_history": f"with {VIEWS} select user_id, item_id, rating from clean",
    "support_counts": f"""with {VIEWS} select 'user' as kind, cast(user_id as varchar) as key, count(*) as n
        from base group by all union all select 'item', item_id, count(*) from base group by all""",
    "rating_cells": f"with {VIEWS} select user_id, item_id, rating from cells",
    "binary_cells": f"with {VIEWS} select user_id, item_id, seen from cells",
    "interaction_cells": f"with {VIEWS} select user_id, item_id, rating, seen from cells",
    "dataset_summary": f"""with {VIEWS} select count(distinct user_id) as users, count(distinct item_id) as items,
        count(*) as cells from cells""",
    "user_means": f"with {VIEWS} select user_id, {_q('avg(rating)', 6)} as mean from cells group by 1",
    "seen_lists": f"""with {VIEWS} select user_id, string_agg(item_id || ':' || cast(cast(round(rating * 10) as int) as varchar),
        '|' order by item_id) as items from cells group by 1""",
    "catalog_denorm": f"""with {VIEWS} select m.id, m.title, m.imdb_id, m.tmdb_id, m.plot,
        coalesce(string_agg(distinct s_name, '|' order by s_name), '') as genres,
        coalesce(string_agg(distinct o_orderpriority, '|' order by o_orderpriority), '') as themes
        from movie m left join lineitem g on g.l_partkey = m.id left join supplier on g.l_suppkey = s_suppkey
        left join lineitem t on t.l_partkey = m.id left join orders on t.l_orderkey = o_orderkey
        group by 1, 2, 3, 4, 5 order by title nulls last, id""",
    "catalog_first": f"with {VIEWS} select tmdb_id, id, title, imdb_id from firsts",
    "pearson_neighbors": f"with {_collaborative(10)} select user_id, other_id, sim, n_common, rank from pearson_nb",
    "cosine_neighbors": f"with {_collaborative(10)} select user_id, other_id, sim, n_common, rank from cosine_nb",
    "pearson_neighbors_batch": f"with {_collaborative()} select user_id, other_id, sim, n_common, rank from pearson_nb",
    "cosine_neighbors_batch": f"with {_collaborative()} select user_id, other_id, sim, n_common, rank from cosine_nb",
    "pearson_matrix": f"""with {_collaborative(ASKING)} select user_id, other_id, sim, n_common
        from moments left join (select user_id, other_id, sim from pearson) using (user_id, other_id)
        union all select user_id, user_id, 1.0, count(*) filter (rating > 0) from cells
            where {ASKING} group by 1""",
    "cosine_matrix": f"""with {_collaborative(ASKING)} select user_id, other_id, sim, n_common from cosine
        union all select user_id, user_id, 1.0, count(*) from cells where {ASKING} group by 1""",
    "pearson_matrix_dense": f"""with {_collaborative(ASKING)} select a.user_id, b.user_id as other_id,
            case when a.user_id = b.user_id then 1.0 else sim end as sim, a.user_id = b.user_id or n_common is not null as met
        from (select distinct user_id from cells where {ASKING}) a cross join (select distinct user_id from cells) b
        left join (select user_id, other_id, n_common, sim from moments left join (select user_id, other_id, sim from pearson)
            using (user_id, other_id)) p on p.user_id = a.user_id and p.other_id = b.user_id""",
    "cosine_matrix_dense": f"""with {_collaborative(ASKING)} select a.user_id, b.user_id as other_id,
            case when a.user_id = b.user_id then 1.0 else coalesce(sim, 0.0) end as sim,
            a.user_id = b.user_id or sim is not null as met
        from (select distinct user_id from cells where {ASKING}) a cross join (select distinct user_id from cells) b
        left join cosine p on p.user_id = a.user_id and p.other_id = b.user_id""",
    "pearson_predict_all": f"""with {_collaborative(ASKING, None)} select user_id, item_id, score, rank
        from ({_ranked('pearson', 2, False)})""",
    "cosine_predict_all": f"""with {_collaborative(ASKING, None)} select user_id, item_id, score, rank
        from ({_ranked('cosine', 3)})""",
    "rec_pearson": f"with {_collaborative(10)} {_recs('pearson', 500)}",
    "rec_cosine": f"with {_collaborative(10)} {_recs('cosine', 500)}",
    "rec_pearson_batch": f"with {_collaborative()} {_recs('pearson', 10)}",
    "rec_cosine_batch": f"with {_collaborative()} {_recs('cosine', 10)}",
    "rec_consensus": f"""{_BOTH} select p.user_id, p.title, p.tmdb_id, p.score as pearson_score,
        c.score as cosine_score from p join c using (user_id, tmdb_id) where p.score > 3.5""",
    "consensus_ids": f"""{_BOTH} select user_id, tmdb_id from p where score > 3.5
        intersect select user_id, tmdb_id from c""",
    "consensus_counts": f"""{_BOTH} select user_id, sum(cast(in_p as int))::bigint as pearson,
        sum(cast(in_c as int))::bigint as cosine, sum(cast(in_p and in_c as int))::bigint as common
        from (select coalesce(a.user_id, b.user_id) as user_id, a.tmdb_id is not null as in_p,
            b.tmdb_id is not null as in_c
            from (select distinct user_id, tmdb_id from p where score > 3.5) a
            full join (select distinct user_id, tmdb_id from c) b
            on a.user_id = b.user_id and a.tmdb_id = b.tmdb_id) group by 1""",
    "user_history": f"""with {VIEWS} select * from (select user_id, f.title, f.tmdb_id, f.imdb_id, f.id as item_id,
        cast(row_number() over (partition by user_id order by f.title nulls last, f.id) as int) as rank
        from usable u join firsts f on f.tmdb_id = u.item_id) where rank <= 10""",
    "user_history_rated": f"""with {VIEWS} select user_id, f.title, f.tmdb_id, rating
        from cells join firsts f on f.tmdb_id = item_id""",
    "user_history_titles": f"""with {VIEWS} select user_id, f.title, f.tmdb_id
        from cells join firsts f on f.tmdb_id = item_id""",
    "history_coverage": f"""with {VIEWS} select user_id, count(f.id) as matched, count(*) as total
        from usable u left join firsts f on f.tmdb_id = u.item_id where u.item_id is not null group by 1""",
    "item_text": f"with {VIEWS}, {_ITEM_TEXT} select * from item_texts",
    "tokens": f"""with {_TEXTS} {_vectors('texts')} select item_id, cast(len(toks) as bigint) as n,
        array_to_string(toks, ' ') as tokens from toks""",
    "ngrams": f"with {_TEXTS} {_vectors('texts')} select item_id, term, tf from tf_all",
    "tfidf_vocab": f"with {_TEXTS} {_vectors('texts')} select term, total, df from vocab",
    "tfidf_vectors": f"with {_TEXTS} {_vectors('texts')} {_VECTOR_ROWS}",
    "tfidf_incremental": f"with {_TEXTS} {_vectors('texts')} {_VECTOR_ROWS}",
    "top_terms": f"""with {_TEXTS} {_vectors('texts')} select item_id, term, {_q('weight', 6)} as weight, rank from (
        select *, cast(row_number() over (partition by item_id order by weight desc, term) as int) as rank from vectors)
        where rank <= 5""",
    "vector_stats": f"""with {_TEXTS} {_vectors('texts')} select item_id, count(*) as non_zero,
        {_q('sum(cast(floor(weight * 1e8 + 0.5) as bigint)) / 1e8', 4)} as weight_sum from vectors group by 1""",
    "content_profile": f"with {CONTENT} select user_id, term, {_q('weight', 6)} as weight from profile",
    "content_score_all": f"""with {CONTENT} select user_id, item_id, {_q('score', 4)} as score,
        cast(row_number() over (partition by user_id order by score desc nulls last, title nulls last, item_id) as int)
        as rank
        from table_all where {ASKING}""",
    "rec_content": _content_recs("user_id = 10", 20),
    "rec_content_batch": _content_recs("true", 10),
    "vector_mean": f"""select label, cast(pos - 1 as int) as pos, {_q('avg(x)', 6)} as mean from (
        select label, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) as pos
        from embeddings) group by label, pos""",
    "vector_cosine": f"""with vals as (select vec_id, label, cast(unnest(embedding) as double) as x,
            generate_subscripts(embedding, 1) as pos from embeddings),
        means as (select label, pos, avg(x) as m from vals group by 1, 2)
        select vec_id, label, {_q('sum(x * m) / sqrt(sum(x * x) * sum(m * m))', 6)} as cosine
        from vals join means using (label, pos) group by 1, 2""",
}
