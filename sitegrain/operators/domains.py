"""Domain facts: DNS summary, providers, markets, lookups with a lifetime, and the per-domain overview."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.functions.urls import with_registrable_domain
from sitegrain.operators.ranking import top_n

# Provider suffix patterns, first match wins.
MAIL_PROVIDERS = [
    (r"google\.com$|googlemail\.com$", "Google Workspace"),
    (r"outlook\.com$|protection\.outlook\.com$", "Microsoft 365"),
    (r"zoho\.(?:com|eu|in)$", "Zoho Mail"),
    (r"protonmail\.ch$|proton\.me$", "Proton Mail"),
    (r"pphosted\.com$", "Proofpoint"),
    (r"mimecast\.com$", "Mimecast"),
    (r"amazonaws\.com$|amazonses\.com$", "Amazon SES/WorkMail"),
    (r"mailgun\.org$", "Mailgun"),
    (r"messagingengine\.com$", "Fastmail"),
    (r"yandex\.(?:net|ru)$", "Yandex Mail"),
    (r"secureserver\.net$", "GoDaddy"),
    (r"icloud\.com$", "iCloud Mail"),
    (r"mx\.cloudflare\.net$", "Cloudflare Email Routing"),
    (r"barracudanetworks\.com$", "Barracuda"),
]
DNS_PROVIDERS = [
    (r"cloudflare\.com$", "Cloudflare"),
    (r"awsdns", "Amazon Route 53"),
    (r"azure-dns\.", "Azure DNS"),
    (r"googledomains\.com$|ns-cloud-[a-z0-9]+\.googledomains\.com$|google\.com$", "Google Cloud DNS"),
    (r"domaincontrol\.com$", "GoDaddy"),
    (r"registrar-servers\.com$", "Namecheap"),
    (r"nsone\.net$", "NS1"),
    (r"ultradns\.", "UltraDNS"),
    (r"dynect\.net$", "Oracle Dyn"),
    (r"akam\.net$|akamaiedge\.net$", "Akamai"),
    (r"vercel-dns\.com$", "Vercel"),
    (r"netlify\.com$", "Netlify"),
    (r"digitalocean\.com$", "DigitalOcean"),
    (r"linode\.com$", "Akamai Linode"),
    (r"hetzner\.(?:com|de)$", "Hetzner"),
    (r"ovh\.net$", "OVHcloud"),
    (r"wixdns\.net$", "Wix"),
    (r"squarespacedns\.com$", "Squarespace"),
    (r"hostgator\.com$", "HostGator"),
    (r"bluehost\.com$", "Bluehost"),
    (r"name-services\.com$", "Enom"),
    (r"dnsimple\.com$", "DNSimple"),
    (r"dnsmadeeasy\.com$", "DNS Made Easy"),
]
# Markets (country, name, language, geo id), languages (code, main country) and language ids.
COUNTRIES = [
    ("us", "United States", "en", 2840), ("gb", "United Kingdom", "en", 2826), ("ca", "Canada", "en", 2124), ("au", "Australia", "en", 2036),
    ("in", "India", "en", 2356), ("ie", "Ireland", "en", 2372), ("nz", "New Zealand", "en", 2554), ("za", "South Africa", "en", 2710),
    ("de", "Germany", "de", 2276), ("fr", "France", "fr", 2250), ("es", "Spain", "es", 2724), ("it", "Italy", "it", 2380),
    ("nl", "Netherlands", "nl", 2528), ("se", "Sweden", "sv", 2752), ("br", "Brazil", "pt", 2076), ("mx", "Mexico", "es", 2484),
    ("jp", "Japan", "ja", 2392),
]
LANGUAGE_COUNTRY = {"en": "us", "de": "de", "fr": "fr", "es": "es", "it": "it", "nl": "nl", "sv": "se", "pt": "br", "ja": "jp"}
LANGUAGE_IDS = {"en": 1000, "de": 1001, "fr": 1002, "es": 1003, "it": 1004, "ja": 1005, "nl": 1010, "pt": 1014, "sv": 1015, "hi": 1023}
SECTIONS = ["traffic", "homepage", "crawlability", "keywords", "registration", "dns", "history", "authority"]
HOMEPAGE_SECTIONS = ["homepage", "crawlability", "keywords"]


def provider(host: Column, table: list[tuple[str, str]]) -> Column:
    """struct<rule, label> of the first pattern that fits; a when-chain, so no row is multiplied by the table."""
    bare = F.regexp_replace(host, r"\.$", "")
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, label in table:
        chain = chain.when(bare.rlike("(?i)" + pattern), label)
    return chain


def dns_summary(records: DataFrame) -> DataFrame:
    """``(domain, type, value, priority, ord, failed)`` records to one row per domain.

    A zone holds few records of a type, so lists per domain are small by nature; TXT is cut to the first 30.
    """
    kind = F.col("type")
    ok = ~F.coalesce(F.col("failed"), F.lit(False)) & F.col("value").isNotNull()
    listed = lambda t: F.array_sort(F.collect_list(F.when(ok & (kind == t), F.struct("ord", "value"))))
    values = lambda c: F.transform(c, lambda x: x["value"])
    mail, name = provider(F.col("value"), MAIL_PROVIDERS), provider(F.col("value"), DNS_PROVIDERS)
    grouped = records.groupBy("domain").agg(
        listed("A").alias("_a"), listed("AAAA").alias("_aaaa"), listed("CNAME").alias("_cname"), listed("TXT").alias("_txt"), listed("CAA").alias("_caa"), listed("DMARC").alias("_dmarc"),
        F.array_sort(F.collect_list(F.when(ok & (kind == "MX"), F.struct("priority", "ord", "value")))).alias("_mx"),
        F.sort_array(F.collect_list(F.when(ok & (kind == "NS"), F.lower("value")))).alias("ns"),
        F.min_by(mail, F.when(ok & (kind == "MX") & mail.isNotNull(), F.struct("priority", "ord"))).alias("mail_provider"),
        F.min_by(name, F.when(ok & (kind == "NS") & name.isNotNull(), F.col("ord"))).alias("dns_provider"),
        F.sort_array(F.collect_set(F.when(F.col("failed"), kind))).alias("failed"))
    first = lambda arr, pattern: F.get(F.filter(arr, lambda t: t.rlike(pattern)), F.lit(0))
    dmarc = first(values("_dmarc"), "(?i)^v=DMARC1")
    return grouped.select(
        "domain", values("_a").alias("a"), values("_aaaa").alias("aaaa"), values("_cname").alias("cname"),
        F.transform("_mx", lambda m: F.struct(m["value"].alias("exchange"), m["priority"].alias("priority"))).alias("mx"), "ns",
        F.slice(values("_txt"), 1, 30).alias("txt"), F.filter(values("_caa"), lambda v: v != "").alias("caa"),
        first(values("_txt"), "(?i)^v=spf1").alias("spf"), dmarc.alias("dmarc"),
        F.nullif(F.lower(F.regexp_extract(dmarc, r"(?i);\s*p=(\w+)", 1)), F.lit("")).alias("dmarc_policy"),
        "mail_provider", "dns_provider", "failed")


def _lookup(pairs: Mapping[str, object], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def markets(domains: DataFrame) -> DataFrame:
    """Search market per ``(domain, lang)``: country-code TLD, else page language and region, else the United States."""
    language = {c: hl for c, _, hl, _ in COUNTRIES}
    alias = lambda c: F.when(c == "uk", "gb").otherwise(c)
    parts = F.split(F.lower(F.coalesce("lang", F.lit(""))), "[-_]")
    lang = F.when(F.get(parts, F.lit(0)).isin(list(LANGUAGE_COUNTRY)), F.get(parts, F.lit(0)))
    region = alias(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    tld = alias(F.substring_index("domain", ".", -1))
    from_tld = F.when(tld.isin(list(language)), tld)
    from_lang = F.when(lang.isNotNull(), F.when(_lookup(language, region) == lang, region).otherwise(_lookup(LANGUAGE_COUNTRY, lang)))
    gl = F.coalesce(from_tld, from_lang, F.lit("us"))
    placed = domains.withColumn("gl", gl).withColumn(
        "hl", F.when(from_tld.isNotNull(), F.coalesce(lang, _lookup(language, F.col("gl")))).otherwise(_lookup(language, F.col("gl"))))
    return placed.withColumns({
        "market": _lookup({c: n for c, n, _, _ in COUNTRIES}, F.col("gl")),
        "location_code": _lookup({c: g for c, _, _, g in COUNTRIES}, F.col("gl")),
        "language_code": _lookup(language, F.col("gl")),
        "language_id": F.coalesce(_lookup(LANGUAGE_IDS, F.col("hl")), _lookup(LANGUAGE_IDS, _lookup(language, F.col("gl")))),
    })


def registration_lookup(domains: DataFrame, servers: DataFrame) -> DataFrame:
    return domains.withColumn("tld", F.lower(F.substring_index("domain", ".", -1))).join(servers, "tld", "left")


def pick_homepage(responses: DataFrame) -> DataFrame:
    """The https answer per host, else the http answer unless the https error forbids a retry."""
    https = F.col("url").startswith("https:")
    final = F.col("error_code").isin("BLOCKED_URL", "ABORTED", "NOT_HTML")
    usable = F.col("error_code").isNull()
    rank = F.when(https & (usable | final), 0).when(~https & usable, 1).when(https, 2)
    return top_n(responses.withColumn("_r", rank).where("_r is not null"), ["host"], [F.col("_r"), F.col("url")], 1).drop("_r")


def latest_lookups(lookups: DataFrame, as_of: Column) -> DataFrame:
    """Newest unexpired successful lookup per key; ``ttl`` is in seconds."""
    alive = lookups.where(~F.col("failed") & (F.unix_timestamp("fetched_at") + F.col("ttl") >= F.unix_timestamp(as_of)))
    rest = [c for c in lookups.columns if c != "key"]
    return alive.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("fetched_at", "value")).alias("v")).select("key", "v.*")


def wanted_sections(raw: str | None) -> list[str]:
    """Sections named in a comma list; unknown names are ignored, none means all, any homepage section brings all three."""
    named = [s for s in (raw or "").split(",") if s in SECTIONS] or SECTIONS
    home = any(s in HOMEPAGE_SECTIONS for s in named)
    return [s for s in SECTIONS if s in named or (home and s in HOMEPAGE_SECTIONS)]


def overview(domains: DataFrame, sections: Mapping[str, DataFrame], only: str | None = None) -> DataFrame:
    """One row per domain with a struct per section; a section without a row has status ``error``.

    Every section is keyed by domain and holds one row per domain, so the joins neither grow nor collect anything.
    """
    out = domains.select("domain").distinct()
    for name in wanted_sections(only):
        if name in sections:
            data = sections[name]
            packed = data.select("domain", F.struct(*[c for c in data.columns if c != "domain"]).alias(name))
            out = out.join(packed, "domain", "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("struct<missing:boolean>"))
        out = out.withColumn(f"{name}_status", F.when(F.col(name).isNotNull(), "ok").otherwise("error"))
    return out


def section_rows(overviews: DataFrame) -> DataFrame:
    """Overview as one row per domain and section."""
    names = [s for s in SECTIONS if f"{s}_status" in overviews.columns]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.col(f"{n}_status").alias("status")) for n in names]))
    return overviews.select("domain", rows.alias("s")).select("domain", "s.*")


def with_domain(df: DataFrame, host: str) -> DataFrame:
    return with_registrable_domain(df, host)
