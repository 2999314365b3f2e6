"""URL and identifier expressions: columns in, columns out, all inside the JVM.

Parts of a URL are taken by pattern rather than by a URL parser, so odd input gives empty parts and no failure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track where a visitor came from (with every utm_*).
TRACKING = "gclid gbraid wbraid fbclid mc_cid mc_eid _ga _gl igshid mno ref source campaign".split()
#: Path segments of pages that hold an account, a cart or a log-in, not content.
SINKS = (
    "login logout signin sign-in signout sign-out register signup sign-up password forgot-password reset-password"
    " account accounts cart checkout wishlist my-account auth oauth sso"
).split()
SINK_PATH = rf"(?i)/(?:{'|'.join(s.replace('-', '-?') for s in SINKS if s != 'accounts')})(?:/|$|\?)"
#: Hosts of the forum and of its short links, and of the channel service.
FORUM_HOSTS = "reddit.com www.reddit.com old.reddit.com new.reddit.com np.reddit.com amp.reddit.com m.reddit.com sh.reddit.com".split()
SHORT_HOSTS = "redd.it www.redd.it".split()
CHANNEL_HOSTS = "t.me telegram.me www.t.me www.telegram.me".split()
#: Profile pages whose path names a user, and first segments that don't.
PROFILES = (
    r"(?i)^https?://(?:www\.)?github\.com/([A-Za-z0-9_-]{1,39})/?$",
    r"(?i)^https?://(?:www\.)?(?:twitter|x)\.com/([A-Za-z0-9_]{1,15})/?$",
    r"(?i)^https?://(?:www\.)?instagram\.com/([A-Za-z0-9_.]{1,30})/?$",
    r"(?i)^https?://(?:www\.)?reddit\.com/u(?:ser)?/([A-Za-z0-9_-]{3,20})/?$",
    r"(?i)^https?://(?:www\.)?t\.me/([A-Za-z0-9_]{5,32})/?$",
)
NOT_USERS = "login signup sign-up about search settings home explore help contact download join signin sign-in terms privacy hashtag share intent".split()

_HEAD = r"^([A-Za-z][A-Za-z0-9+.-]*)://"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), _HEAD, 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), _HEAD + r"([^/?#]*)", 2)


def extract_domain(url: Column) -> Column:
    """Lower-cased host without user, port: the exact host."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", ""))


def host_key(url: Column) -> Column:
    """Host without a leading www., null if there is none."""
    return F.nullif(F.regexp_replace(extract_domain(url), r"^www\.", ""), F.lit(""))


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def normalize_url(url: Column) -> Column:
    """Canonical URL: lower-cased scheme and host, no user, default port, fragment, trailing slash or tracking parameter.

    Other parameters keep their order and blank values; a pair without = gets one and a percent-encoded space becomes +.
    """
    port = F.regexp_extract(authority(url), r":([0-9]+)$", 1)
    default = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    place = F.when((port == "") | default, extract_domain(url)).otherwise(F.concat(extract_domain(url), F.lit(":"), port))
    p = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    p = F.when(F.length(p) > 1, F.regexp_replace(p, "/+$", "")).otherwise(p)
    name = lambda x: F.lower(F.regexp_extract(x, "^([^=]*)", 1))
    pairs = F.filter(F.split(query(url), "&"), lambda x: (x != "") & ~name(x).startswith("utm_") & ~name(x).isin(TRACKING))
    pairs = F.transform(pairs, lambda x: F.replace(F.when(x.contains("="), x).otherwise(F.concat(x, F.lit("="))), F.lit("%20"), F.lit("+")))
    q = F.array_join(pairs, "&")
    return F.concat(scheme(url), F.lit("://"), place, p, F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))


def url_pattern(url: Column) -> Column:
    """URL with path segments that vary replaced by {uuid}, {id} or {slug}; the query is dropped."""
    segments = F.filter(F.split(path(url), "/"), lambda s: s != "")

    def kind(s):
        return (
            F.when(s.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), "{uuid}")
            .when(s.rlike(r"^\p{Nd}+$"), "{id}")
            .when(s.rlike(r"^[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+){2,}$"), "{slug}")
            .when(s.rlike("(?i)^[a-z0-9]{6,}$") & s.rlike("[0-9]") & s.rlike("(?i)[a-z]"), "{id}")
            .otherwise(s)
        )

    p = F.concat(F.lit("/"), F.array_join(F.transform(segments, kind), "/"))
    return F.when(scheme(url) == "", p).otherwise(F.concat(scheme(url), F.lit("://"), authority(url), p))


def sink_reason(url: Column) -> Column:
    """Why a URL is no content page: sink_segment:<name> or sink_path_pattern; null for content."""
    found = F.filter(F.split(F.lower(path(url)), "/"), lambda s: s.isin(SINKS))
    whole = F.when(query(url) == "", path(url)).otherwise(F.concat(path(url), F.lit("?"), query(url)))
    first = F.try_element_at(found, F.lit(1))
    return F.when(first.isNotNull(), F.concat(F.lit("sink_segment:"), first)).when((path(url) != "") & whole.rlike(SINK_PATH), "sink_path_pattern")


def _with_scheme(url: Column) -> Column:
    t = F.trim(url)
    return F.when(t.contains("://"), t).otherwise(F.concat(F.lit("https://"), t))


def classify_forum_url(url: Column) -> Column:
    """struct(kind, subreddit, post_id, comment_id) of a forum link; null for any other."""
    u = _with_scheme(url)
    host, p = extract_domain(u), path(u)
    part = lambda pattern, i: F.nullif(F.regexp_extract(p, pattern, i), F.lit(""))
    post, sub = "[A-Za-z0-9]{1,10}", "[A-Za-z0-9_]{2,21}"
    comment = rf"^/r/({sub})/comments/({post})/[^/]*/({post})/?$"
    user_comment = rf"^/user/[A-Za-z0-9_-]+/comments/({post})/[^/]*/({post})/?$"
    thread = rf"^/r/({sub})/comments/({post})(?:/[^/]*)?/?$"
    user_post = rf"^/user/[A-Za-z0-9_-]+/comments/({post})/?$"
    board, short = rf"^/r/({sub})/?$", rf"^/({post})/?$"
    no = F.lit(None).cast("string")
    row = lambda kind, s, q, c: F.struct(F.lit(kind).alias("kind"), s.alias("subreddit"), q.alias("post_id"), c.alias("comment_id"))
    forum = host.isin(FORUM_HOSTS)
    return (
        F.when(host.isin(SHORT_HOSTS) & p.rlike(short), row("post", no, part(short, 1), no))
        .when(forum & p.rlike(comment), row("comment", part(comment, 1), part(comment, 2), part(comment, 3)))
        .when(forum & p.rlike(user_comment), row("comment", no, part(user_comment, 1), part(user_comment, 2)))
        .when(forum & p.rlike(thread), row("post", part(thread, 1), part(thread, 2), no))
        .when(forum & p.rlike(user_post), row("post", no, part(user_post, 1), no))
        .when(forum & p.rlike(board), row("subreddit", part(board, 1), no, no))
    )


def normalize_channel_id(raw: Column) -> Column:
    """struct(kind, value, normalized) of a channel name, link, invite or number; null if it is none of these."""
    t = F.regexp_replace(F.regexp_replace(F.trim(raw), r"(?i)^(https?://)?(www\.)?t\.me/", ""), "/+$", "")
    bare = F.regexp_replace(t, "^@", "")
    invite = F.regexp_extract(t, r"^(?:joinchat/|\+)(.*)$", 1)
    row = lambda kind, v, n: F.struct(F.lit(kind).alias("kind"), v.alias("value"), n.alias("normalized"))
    return (
        F.when(t.rlike(r"^(?:joinchat/|\+)"), row("invite_hash", invite, F.concat(F.lit("https://t.me/+"), invite)))
        .when(bare.rlike("^-?[0-9]+$"), row("numeric_id", bare, bare))
        .when(bare.rlike("^[A-Za-z0-9_]{3,32}$"), row("username", bare, F.concat(F.lit("@"), F.lower(bare))))
    )


def classify_channel_url(url: Column) -> Column:
    """As normalize_channel_id, of links to the channel service only."""
    u = _with_scheme(url)
    rest = F.concat(F.regexp_replace(path(u), "^/+", ""), F.when(query(u) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(u))))
    return F.when(extract_domain(u).isin(CHANNEL_HOSTS) & (rest != ""), normalize_channel_id(F.concat(F.lit("https://t.me/"), rest)))


def normalize_identifier(raw: Column) -> Column:
    """struct(type, value): an e-mail address, phone number, domain, user name or person name in canonical form; null if blank or invalid.

    Phone numbers follow a rule on digits (a leading + or 00 keeps the country code, ten bare digits stay as they are), not numbering plans.
    """
    t = F.trim(raw)
    domain = F.regexp_replace(F.regexp_replace(F.lower(F.when(t.rlike("^https?://"), authority(t)).otherwise(t)), "[/:].*$", ""), r"^www\.", "")
    is_domain = domain.rlike(r"^(?!-)[a-z0-9-]{1,63}(?<!-)(\.[a-z0-9-]{1,63})+$")
    digits = F.regexp_replace(t, r"[\s()+-]", "")
    row = lambda kind, v: F.struct(F.lit(kind).alias("type"), v.alias("value"))
    phone = F.when(t.rlike(r"^\s*(\+|00)"), F.concat(F.lit("+"), F.regexp_replace(digits, "^00", ""))).otherwise(digits)
    return (
        F.when(t.isNull() | (t == ""), F.lit(None))
        .when(t.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), row("EMAIL", F.lower(t)))
        .when(digits.rlike("^[0-9]{7,}$"), F.when(F.length(digits) <= 15, row("PHONE", phone)))
        .when(t.startswith("http") | is_domain, F.when(is_domain, row("DOMAIN", domain)))
        .when(t.startswith("@") | t.rlike("^[A-Za-z0-9_.]+$"), F.when(~t.rlike(r"\s") & ~t.rlike("^@+$"), row("USERNAME", F.lower(F.regexp_replace(t, "^@+", "")))))
        .otherwise(row("PERSON_NAME", F.initcap(F.regexp_replace(t, r"\s+", " "))))
    )


def profile_handle(url: Column) -> Column:
    """User name of a profile page of a known site, or null."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(F.trim(url), p, 1), F.lit("")) for p in PROFILES])
    return F.when(~F.lower(found).isin(NOT_USERS), found)


def pagination_pattern(url: Column) -> Column:
    """URL with the page number or offset replaced by its name in braces."""
    p = F.regexp_replace(url, r"(?i)([?&](?:page|pg|p)=)\d+", r"$1{page}")
    p = F.when(p == url, F.regexp_replace(url, r"(?i)/page[/-]\d+/?$", "/page/{page}")).otherwise(p)
    out = p
    for name in ("skip", "from", "start", "offset"):
        out = F.when(F.lower(p).contains(f"{name}="), F.regexp_replace(p, rf"(?<=[?&])({name}=)[^&#]*", rf"$1{{{name}}}")).otherwise(out)
    return out
