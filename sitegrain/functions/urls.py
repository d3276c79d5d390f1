"""URL handling as Column expressions over the text of the URL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESOURCE_PATH = (
    r"(?i)\.(pdf|zip|gz|rar|7z|tar|jpe?g|png|gif|webp|avif|svg|ico|bmp|tiff?|mp4|webm|mov|avi|mp3|wav|ogg|m4a|docx?|xlsx?"
    r"|pptx?|csv|exe|dmg|apk|msi|iso|css|js|mjs|json|woff2?|ttf|otf|eot)$"
)
HTTP_URL = r"(?i)^https?://[^/?#\s]+"
# Characters a URL path keeps as they are; anything else is percent-encoded.
_PLAIN_PATH = r"^[A-Za-z0-9!$%&'()*+,\-./:;=@\[\]\\_|~^]*$"
_PLAIN_CHAR = r"^[A-Za-z0-9!$%&'()*+,\-./:;=@\[\]\\_|~^]$"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def authority_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def host_of(url: Column) -> Column:
    bare = F.regexp_replace(authority_of(url), r"^.*@", "")
    return F.lower(F.regexp_replace(bare, r":\d*$", ""))


def port_of(url: Column) -> Column:
    given = F.regexp_extract(authority_of(url), r":(\d+)$", 1)
    default = F.when(scheme_of(url) == "https", 443).otherwise(80)
    return F.when(given != "", given.try_cast("int")).otherwise(default)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def query_of(url: Column) -> Column:
    """Query with its question mark, or an empty string."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def origin_of(url: Column) -> Column:
    default = ((scheme_of(url) == "https") & (port_of(url) == 443)) | ((scheme_of(url) == "http") & (port_of(url) == 80))
    port = F.when(default, "").otherwise(F.concat(F.lit(":"), port_of(url).cast("string")))
    return F.concat(scheme_of(url), F.lit("://"), host_of(url), port)


def path_and_query(url: Column) -> Column:
    """``/path?query`` of a web URL; other text is returned unchanged."""
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(url.rlike(HTTP_URL), F.concat(path, query_of(url))).otherwise(url)


def encode_path(path: Column) -> Column:
    encoded = F.array_join(
        F.transform(
            F.split(path, ""),
            lambda c: F.when((c == "") | c.rlike(_PLAIN_CHAR), c).when(c == " ", "%20").otherwise(F.url_encode(c)),
        ),
        "",
    )
    return F.when(path.rlike(_PLAIN_PATH), path).otherwise(encoded)


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of an absolute path."""

    def fold(done: Column, seg: Column) -> Column:
        up = F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
        return F.when(seg == ".", done).when(seg == "..", up).otherwise(F.array_append(done, seg))

    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    folded = F.aggregate(segments, F.array(F.lit("")), fold)
    tail = F.when(path.rlike(r"/\.{1,2}$"), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(folded, "/"), tail)).otherwise(path)


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and host, default port and fragment dropped; unparsable text stays as it is."""
    path = F.when(path_of(url) == "", "/").otherwise(encode_path(_fold_dots(path_of(url))))
    clean = F.concat(origin_of(url), path, query_of(url))
    return F.when(url.rlike(HTTP_URL), clean).otherwise(url)


def resolve_link(href: Column, base: Column) -> Column:
    """Absolute form of a link found on ``base``; null for fragments and non-web schemes."""
    raw = F.trim(F.regexp_replace(href, r"[\t\r\n]", ""))
    folder = F.regexp_replace(F.when(path_of(base) == "", "/").otherwise(path_of(base)), r"[^/]*$", "")
    target = (
        F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), raw)
        .when(raw.startswith("//"), F.concat(scheme_of(base), F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(origin_of(base), raw))
        .when(raw.startswith("?"), F.concat(origin_of(base), path_of(base), raw))
        .otherwise(F.concat(origin_of(base), folder, raw))
    )
    usable = (raw != "") & ~raw.startswith("#") & target.rlike(HTTP_URL)
    return F.when(usable, normalize_url(target))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def same_site(a: Column, b: Column) -> Column:
    """Hosts equal but for one leading www; scheme and port play no part."""
    left, right = strip_www(host_of(a)), strip_www(host_of(b))
    return (left != "") & (left == right)


def is_resource(url: Column) -> Column:
    return path_of(url).rlike(RESOURCE_PATH)


def parse_url_input(raw: Column) -> Column:
    """A typed URL made absolute; null when it is not a public web address."""
    text = F.trim(raw)
    full = F.when(text.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), text).otherwise(F.concat(F.lit("https://"), text))
    good = (text != "") & (F.length(text) <= 2048) & full.rlike(HTTP_URL) & host_of(full).contains(".")
    return F.when(good, normalize_url(full))


def is_ip_literal(host: Column) -> Column:
    return host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | host.rlike(r"^\[?[0-9a-f]*:[0-9a-f:.]*\]?$")


def is_public_ipv4(host: Column) -> Column:
    """Globally routable unicast, decided by arithmetic on the four octets."""
    part = [F.split_part(host, F.lit("."), F.lit(i)).try_cast("int") for i in range(1, 5)]
    a, b, c, d = part
    valid = F.lit(True)
    for p in part:
        valid = valid & p.between(0, 255)
    special = (
        a.isin(0, 10, 127)
        | (a >= 224)
        | ((a == 100) & b.between(64, 127))
        | ((a == 169) & (b == 254))
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 192) & (b == 0) & c.isin(0, 2))
        | ((a == 192) & (b == 88) & (c == 99))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
    )
    return F.coalesce(valid & ~special, F.lit(False))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ipv6_groups(host: Column) -> Column:
    """The eight numbers of an IPv6 literal, with a dotted end and ``::`` written out; null if it isn't one."""
    pair = lambda a, b: F.lower(F.hex(a * 256 + b))
    octets = F.transform(F.split(F.regexp_extract(host, r":(\d{1,3}(\.\d{1,3}){3})$", 1), r"\."), lambda o: o.try_cast("int"))
    written = lambda o: F.when(F.size(o) == 4, F.concat(F.regexp_replace(host, r"[\d.]+$", ""), pair(o[0], o[1]), F.lit(":"), pair(o[2], o[3]))).otherwise(host)
    groups = lambda half: F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")

    def filled(halves: Column) -> Column:
        left, right = groups(F.get(halves, F.lit(0))), groups(F.get(halves, F.lit(1)))
        missing = F.when(F.size(halves) == 2, F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))).otherwise(0)
        return F.when(F.size(halves) <= 2, F.concat(left, F.array_repeat(F.lit("0"), missing), right))

    def numbers(every: Column) -> Column:
        good = (F.size(every) == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.transform(every, lambda g: F.conv(g, 16, 10).cast("int")))

    in_range = let(octets, lambda o: F.when(F.forall(o, lambda x: F.coalesce(x <= 255, F.lit(True))), written(o)))
    return let(F.split(in_range, "::"), lambda halves: let(filled(halves), numbers))


def is_public_ipv6(host: Column) -> Column:
    """Unicast outside all reserved ranges, decided by arithmetic on the groups; a mapped IPv4 address counts as that address."""

    def verdict(groups: Column) -> Column:
        g = [F.get(groups, F.lit(i)) for i in range(8)]
        zero = lambda a, b: F.forall(F.slice(groups, a + 1, b - a), lambda x: x == 0)
        mapped = F.concat_ws(".", F.shiftright(g[6], 8), g[6] % 256, F.shiftright(g[7], 8), g[7] % 256)
        # Reserved IPv6 ranges.
        special = (
            (zero(0, 7) & g[7].isin(0, 1))
            | (g[0] >= 0xFF00)
            | g[0].between(0xFE80, 0xFEBF)
            | g[0].between(0xFC00, 0xFDFF)
            | ((g[0] == 0x100) & zero(1, 4))
            | (zero(0, 4) & (g[4] == 0xFFFF) & (g[5] == 0))
            | ((g[0] == 0x64) & (g[1] == 0xFF9B) & zero(2, 6))
            | (g[0] == 0x2002)
            | ((g[0] == 0x2001) & ((g[1] < 0x200) | (g[1] == 0xDB8)))
        )
        return F.when(zero(0, 5) & (g[5] == 0xFFFF), let(mapped, is_public_ipv4)).otherwise(~special)

    return F.coalesce(let(ipv6_groups(host), verdict), F.lit(False))


def reject_reason(url: Column) -> Column:
    """Why a URL may not be fetched; null when it may."""
    return let(F.regexp_replace(host_of(url), r"^\[|\]$", ""), lambda host: _reject_reason(url, host))


def _reject_reason(url: Column, host: Column) -> Column:
    local = (host == "localhost") | host.rlike(r"\.(localhost|local|internal|lan)$") | ~host.contains(".")
    v4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    return (
        F.when(~scheme_of(url).isin("http", "https"), "scheme")
        .when(authority_of(url).contains("@"), "credentials")
        .when(~port_of(url).isin(80, 443, 8080, 8443), "port")
        .when(v4 & ~is_public_ipv4(host), "address")
        .when(host.contains(":") & ~is_public_ipv6(host), "address")
        .when(~v4 & ~host.contains(":") & local, "host")
    )


# Suffixes of more than one label that matter when no full suffix table is given.
DEFAULT_SUFFIXES = [
    "co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "com.br",
    "com.mx", "co.jp", "ne.jp", "or.jp", "github.io", "vercel.app", "netlify.app", "pages.dev", "blogspot.com",
]


def with_registrable_domain(df: DataFrame, host: str, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds ``public_suffix`` and ``domain`` (suffix plus one label); null for IP literals and bare suffixes.

    ``suffixes(suffix)`` is a public-suffix table of rules as its list has them: a name, ``*.name`` for any one label before a name, and ``!name`` for
    an exception to such a rule, whose suffix is the name without its first label. An exception wins, then the longest match, else the last label.
    Each host meets only rules that could be its own, by one join on the rule.
    """
    hosts = df.select(host).distinct()
    labels = F.split(F.col(host), r"\.")
    end = lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    way = lambda rule, suffix, rank: F.struct(rule.alias("rule"), suffix.alias("suffix"), F.lit(rank).alias("rank"))
    ways = F.flatten(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array(
        way(end(i), end(i), 0), way(F.concat(F.lit("*."), end(i + 1)), end(i), 0), way(F.concat(F.lit("!"), end(i)), end(i + 1), 1))))
    named = hosts.where(F.col(host).contains(".") & ~is_ip_literal(F.col(host))).select(host, F.explode(ways).alias("w")).select(host, "w.*")
    if suffixes is None:
        ruled = named.where(F.col("rule").isin(DEFAULT_SUFFIXES))
    else:
        ruled = named.join(suffixes.select(F.lower("suffix").alias("rule")).distinct(), "rule").select(*named.columns)
    last = hosts.where(F.col(host).contains(".") & ~is_ip_literal(F.col(host))).select(host, F.lit("").alias("rule"), F.substring_index(host, ".", -1).alias("suffix"), F.lit(0).alias("rank"))
    best = ruled.unionByName(last).groupBy(host).agg(F.max_by("suffix", F.struct("rank", F.length("suffix"))).alias("public_suffix"))
    rest = F.expr(f"left(`{host}`, length(`{host}`) - length(public_suffix) - 1)")
    domain = F.when(rest != "", F.concat(F.substring_index(rest, ".", -1), F.lit("."), F.col("public_suffix")))
    return df.join(best.withColumn("domain", domain), host, "left")


def breadcrumb(url: Column) -> Column:
    """Host and decoded path parts as a result page shows them."""
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    decoded = F.transform(parts, lambda p: F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))))
    line = F.array_join(F.concat(F.array(strip_www(host_of(url))), decoded), " › ")
    failed = F.exists(decoded, lambda p: p.isNull())
    return F.when(url.rlike(HTTP_URL) & ~failed, F.substring(line, 1, 120)).otherwise(url)
