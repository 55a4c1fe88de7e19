"""Queries for the scalar text / HTML / URL functions and model math
(T1-T13, M1-M3), each over a whole driver table."""

from __future__ import annotations

from pyspark.sql import functions as F

from threatsift.functions import text as X
from threatsift.functions import urls as U
from threatsift.operators.scoring import decide_email, decide_url, softmax
from threatsift.plans import sqltext as S
from threatsift.plans.catalog import query
from threatsift.plans.views import sub, view


def sql_html_to_text(e: str) -> str:
    x = e
    x = f"regexp_replace({x}, {S.lit(r'(?is)<script\b[^>]*>.*?</script\s*>')}, ' ', 'g')"
    x = f"regexp_replace({x}, {S.lit(r'(?is)<style\b[^>]*>.*?</style\s*>')}, ' ', 'g')"
    x = f"regexp_replace({x}, {S.lit(r'(?s)<!--.*?-->')}, ' ', 'g')"
    x = f"regexp_replace({x}, {S.lit(r'<[!/?a-zA-Z][^>]*>')}, ' ', 'g')"
    for ent, ch in X.NATIVE_ENTITIES:
        x = f"replace({x}, {S.lit(ent)}, {S.lit(ch)})"
    return S.collapse(x)


def sql_is_html(e: str) -> str:
    return f"(strpos(lower({e}), '<html') > 0 OR strpos({e}, '</') > 0)"


def sql_clean_message(e: str) -> str:
    inner = f"CASE WHEN {sql_is_html(e)} THEN {sql_html_to_text(e)} ELSE {e} END"
    return S.strip(f"regexp_replace({inner}, {S.lit(S.WS + '+')}, ' ', 'g')")


# ---------------------------------------------------------------- T1-T3

@query("html_to_text", lambda: f"SELECT page_id, {sql_html_to_text('html')} AS text FROM pages", headline=True)
def q_html_to_text(spark, sf_dir):
    """Visible text of every page."""
    return view(spark, sf_dir, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


def _docs_and_pages(spark, sf_dir):
    docs = view(spark, sf_dir, "documents").select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.col("text").alias("raw"))
    pages = view(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("raw"))
    return docs.unionByName(pages)


SQL_DOCS_AND_PAGES = ("(SELECT 'documents' AS src, doc_id AS id, text AS raw FROM documents "
                      "UNION ALL SELECT 'pages', page_id, html FROM pages) dp")


@query("is_html", lambda: f"SELECT src, id, {sql_is_html('raw')} AS is_html FROM {SQL_DOCS_AND_PAGES}")
def q_is_html(spark, sf_dir):
    """HTML sniffing over documents and pages."""
    return _docs_and_pages(spark, sf_dir).select("src", "id", X.is_html(F.col("raw")).alias("is_html"))


@query("clean_message", lambda: f"SELECT src, id, {sql_clean_message('raw')} AS text FROM {SQL_DOCS_AND_PAGES}")
def q_clean_message(spark, sf_dir):
    """Message cleaner (HTML to text when HTML, collapse, strip)."""
    return _docs_and_pages(spark, sf_dir).select("src", "id", X.clean_message(F.col("raw")).alias("text"))


# ---------------------------------------------------------------- T4-T6, T12, T13

@query("extract_urls", lambda: (
    f"SELECT msg_id, CAST(len(u) AS INTEGER) AS n_urls, array_to_string(u, ' ') AS urls FROM "
    f"(SELECT msg_id, {S.extract_urls('text')} AS u FROM {sub('v_messages')} vm) t"))
def q_extract_urls(spark, sf_dir):
    """T4: ordered URL list per message (count and space-joined list)."""
    m = view(spark, sf_dir, "v_messages").select("msg_id", X.extract_urls(F.col("text")).alias("u"))
    return m.select("msg_id", F.size("u").alias("n_urls"), F.array_join("u", " ").alias("urls"))


@query("explode_urls", lambda: (
    f"SELECT msg_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS url_pos, unnest(u) AS url FROM "
    f"(SELECT msg_id, {S.extract_urls('text')} AS u FROM {sub('v_messages')} vm) t"))
def q_explode_urls(spark, sf_dir):
    """T5: one row per URL occurrence with its position (posexplode)."""
    m = view(spark, sf_dir, "v_messages")
    return m.select("msg_id", F.posexplode(X.extract_urls(F.col("text"))).alias("url_pos", "url"))


@query("extract_urls_ui", lambda: (
    f"SELECT msg_id, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS url_pos, unnest(u) AS url FROM "
    f"(SELECT msg_id, {S.extract_urls_ui('text')} AS u FROM {sub('v_messages')} vm) t"))
def q_extract_urls_ui(spark, sf_dir):
    """The UI extractor's URLs (stops at quotes, keeps punctuation)."""
    m = view(spark, sf_dir, "v_messages")
    return m.select("msg_id", F.posexplode(X.extract_urls_ui(F.col("text"))).alias("url_pos", "url"))


@query("trim_input", lambda: (
    f"SELECT msg_id, {S.strip('text')} AS text_clean, lower({S.strip('text')}) AS email_text FROM {sub('v_messages')} vm"))
def q_trim_input(spark, sf_dir):
    """Request text stripped (URL path) and lowercased (email path)."""
    m = view(spark, sf_dir, "v_messages")
    return m.select("msg_id", X.trim_input(F.col("text")).alias("text_clean"),
                    X.trim_input(F.col("text"), lowercase=True).alias("email_text"))


def sql_route(e: str) -> str:
    x = S.strip(e)
    return (f"CASE WHEN NOT regexp_matches({x}, {S.lit(S.WS)}) AND regexp_matches(lower({x}), '^(https?://|www\\.)') "
            f"THEN 'url' ELSE 'email' END")


@query("route_input", lambda: (
    f"SELECT src, id, {sql_route('raw')} AS input_type FROM (SELECT 'messages' AS src, msg_id AS id, text AS raw FROM {sub('v_messages')} vm "
    f"UNION ALL SELECT 'pages', page_id, url FROM pages) r"))
def q_route_input(spark, sf_dir):
    """Url vs email routing by shape, over messages and page URLs."""
    m = view(spark, sf_dir, "v_messages").select(F.lit("messages").alias("src"), F.col("msg_id").alias("id"), F.col("text").alias("raw"))
    p = view(spark, sf_dir, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("url").alias("raw"))
    return m.unionByName(p).select("src", "id", X.route_input(F.col("raw")).alias("input_type"))


# ---------------------------------------------------------------- T7-T11 over page URLs

@query("normalize_url", lambda: f"SELECT page_id, norm_url FROM ({S.normalize_url_select('pages', 'page_id', 'url')}) n")
def q_normalize_url(spark, sf_dir):
    """Canonical URL of every page."""
    return view(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.col("url")).alias("norm_url"))


@query("split_url", lambda: (
    f"SELECT page_id, {', '.join(f'{S.url_part(S.prepare_url('url'), i)} AS {n}' for i, n in enumerate(('scheme', 'netloc', 'path', 'query', 'fragment'), 1))} FROM pages"))
def q_split_url(spark, sf_dir):
    """Urlsplit parts of every (prepared) page URL."""
    p = view(spark, sf_dir, "pages").select("page_id", U.split_url(U.prepare(F.col("url"))).alias("s"))
    return p.select("page_id", "s.scheme", "s.netloc", "s.path", "s.query", "s.fragment")


@query("strip_tracking", lambda: (
    f"SELECT page_id, q AS query, {S.strip_tracking('q')} AS stripped FROM "
    f"(SELECT page_id, {S.url_part(S.prepare_url('url'), 4)} AS q FROM pages) t"))
def q_strip_tracking(spark, sf_dir):
    """Query string of every page URL with tracking keys removed."""
    p = view(spark, sf_dir, "pages").select("page_id", U.split_url(U.prepare(F.col("url")))["query"].alias("query"))
    return p.select("page_id", "query", U.strip_tracking(F.col("query")).alias("stripped"))


@query("recode_path", lambda: (
    f"SELECT page_id, path, {S.recode_path('path')} AS recoded FROM "
    f"(SELECT page_id, {S.url_part(S.prepare_url('url'), 3)} AS path FROM pages) t"))
def q_recode_path(spark, sf_dir):
    """Percent-decode and re-encode the path of every page URL."""
    p = view(spark, sf_dir, "pages").select("page_id", U.split_url(U.prepare(F.col("url")))["path"].alias("path"))
    return p.select("page_id", "path", U.recode_path(F.col("path")).alias("recoded"))


@query("url_domain", lambda: (
    f"SELECT page_id, {S.url_domain('norm_url')} AS domain FROM ({S.normalize_url_select('pages', 'page_id', 'url')}) n"))
def q_url_domain(spark, sf_dir):
    """Allowlist domain of every page URL."""
    p = view(spark, sf_dir, "pages")
    return p.select("page_id", U.url_domain(U.normalize_url(F.col("url"))).alias("domain"))


# ---------------------------------------------------------------- M1-M3: class k's logit is the
# sum of the vector's components k, k + n, k + 2n, ... (every component counts)

def sql_softmax(n: int) -> dict[int, str]:
    xs = [f"round(list_sum(list_transform(embedding[{i + 1}:len(embedding):{n}], lambda e: CAST(e AS DOUBLE))), 9)" for i in range(n)]
    m = f"greatest({', '.join(xs)})"
    es = [f"exp({x} - {m})" for x in xs]
    tot = " + ".join(es)
    return {i: f"({es[i]}) / ({tot})" for i in range(n)}


def _probs(spark, sf_dir, n):
    e = view(spark, sf_dir, "embeddings")
    def logit(k):
        part = F.filter("embedding", lambda _, i: i % n == k)
        return F.round(F.aggregate(part, F.lit(0.0), lambda a, v: a + v.cast("double")), 9)
    return e.select("vec_id", softmax(F.array(*[logit(k) for k in range(n)])).alias("p"))


@query("softmax", lambda: "SELECT vec_id, " + ", ".join(f"round({x}, 6) AS p{i}" for i, x in sql_softmax(3).items()) + " FROM embeddings")
def q_softmax(spark, sf_dir):
    """M1: softmax of three logits summed from the whole embedding."""
    p = _probs(spark, sf_dir, 3)
    return p.select("vec_id", *[F.round(F.col("p")[i], 6).alias(f"p{i}") for i in range(3)])


@query("decide_email", lambda: (
    "SELECT vec_id, " + ", ".join(f"{v} AS {k}" for k, v in S.decide_email("pl", "ps", "pp").items())
    + f" FROM (SELECT vec_id, {sql_softmax(3)[0]} AS pl, {sql_softmax(3)[1]} AS ps, {sql_softmax(3)[2]} AS pp FROM embeddings) t"))
def q_decide_email(spark, sf_dir):
    """M2 (+T15): 3-class decision over softmaxed logits."""
    p = _probs(spark, sf_dir, 3)
    d = decide_email(F.col("p")[0], F.col("p")[1], F.col("p")[2])
    return p.select("vec_id", *[v.alias(k) for k, v in d.items()])


@query("decide_url", lambda: (
    "SELECT vec_id, " + ", ".join(f"{v} AS {k}" for k, v in S.decide_url("pl", "pp").items())
    + f" FROM (SELECT vec_id, {sql_softmax(2)[0]} AS pl, {sql_softmax(2)[1]} AS pp FROM embeddings) t"))
def q_decide_url(spark, sf_dir):
    """M3 (+T15): 2-class decision over softmaxed logits."""
    p = _probs(spark, sf_dir, 2)
    d = decide_url(F.col("p")[0], F.col("p")[1])
    return p.select("vec_id", *[v.alias(k) for k, v in d.items()])


@query("sql_normalize_url", lambda: f"SELECT page_id, norm_url FROM ({S.normalize_url_select('pages', 'page_id', 'url')}) n")
def q_sql_normalize_url(spark, sf_dir):
    """2.11: the URL normaliser called from SQL (registered SQL function)."""
    from threatsift.functions import sqlfuncs
    view(spark, sf_dir, "pages")
    sqlfuncs.register(spark)
    return spark.sql("SELECT page_id, ts_normalize_url(url) AS norm_url FROM pages")
