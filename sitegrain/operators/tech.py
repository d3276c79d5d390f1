"""Technology fingerprints: evidence from headers, generator, cookies, script URLs and HTML."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values: (name, category, patterns); patterns ignore case.
SIGNATURES: list[tuple[str, str, dict]] = [
    ("WordPress", "CMS", {"generator": r"wordpress", "html": r"/wp-(?:content|includes)/", "version": r"wordpress\s*([\d.]+)"}),
    ("Drupal", "CMS", {"headers": {"x-generator": r"drupal", "x-drupal-cache": r"."}, "generator": r"drupal", "html": r"drupal-settings-json|/sites/default/files/", "version": r"drupal\s*([\d.]+)"}),
    ("Joomla", "CMS", {"generator": r"joomla", "html": r"/media/jui/|option=com_"}),
    ("Ghost", "CMS", {"generator": r"ghost", "version": r"ghost\s*([\d.]+)"}),
    ("Wix", "CMS", {"headers": {"x-wix-request-id": r"."}, "html": r"static\.wixstatic\.com|wix-bolt|_wixCIDX"}),
    ("Squarespace", "CMS", {"html": r"static1\.squarespace\.com|squarespace-cdn\.com|Static\.SQUARESPACE_CONTEXT"}),
    ("Webflow", "CMS", {"generator": r"webflow", "html": r"data-wf-(?:site|page)=|assets\.website-files\.com|cdn\.prod\.website-files\.com"}),
    ("Framer", "CMS", {"generator": r"framer", "html": r"framerusercontent\.com|data-framer-"}),
    ("HubSpot CMS", "CMS", {"headers": {"x-hs-hub-id": r"."}, "html": r"hs-sites\.com|hubspotusercontent"}),
    ("Blogger", "CMS", {"generator": r"blogger", "html": r"blogger\.com/static|blogblog\.com"}),
    ("Typo3", "CMS", {"generator": r"typo3"}),
    ("Contentful", "CMS", {"html": r"images\.ctfassets\.net"}),
    ("Sanity", "CMS", {"html": r"cdn\.sanity\.io"}),
    ("Notion", "CMS", {"html": r"notion-static\.com|<meta[^>]+notion-site"}),
    ("Mintlify", "CMS", {"html": r'mintlify\.s3|mintcdn\.com|generator" content="Mintlify'}),
    ("Shopify", "Ecommerce", {"headers": {"x-shopid": r".", "x-shopify-stage": r"."}, "html": r"cdn\.shopify\.com|Shopify\.theme"}),
    ("WooCommerce", "Ecommerce", {"html": r"woocommerce"}),
    ("Magento", "Ecommerce", {"cookies": r"(?:^|\s)(?:frontend|mage-cache-storage)=", "html": r"Mage\.Cookies|/static/version\d+/frontend/"}),
    ("BigCommerce", "Ecommerce", {"html": r"cdn\d*\.bigcommerce\.com"}),
    ("PrestaShop", "Ecommerce", {"generator": r"prestashop", "html": r"prestashop"}),
    ("Salesforce Commerce Cloud", "Ecommerce", {"html": r"demandware\.static|dwanalytics"}),
    ("Next.js", "Framework", {"headers": {"x-powered-by": r"next\.js", "x-nextjs-cache": r"."}, "html": r"__NEXT_DATA__|/_next/static/"}),
    ("Nuxt", "Framework", {"html": r"__NUXT__|/_nuxt/"}),
    ("Gatsby", "Static site generator", {"generator": r"gatsby", "html": r"___gatsby|gatsby-image"}),
    ("Astro", "Framework", {"generator": r"astro", "html": r"<astro-island|astro-[a-z0-9]{6,}", "version": r"astro\s*v?([\d.]+)"}),
    ("SvelteKit", "Framework", {"html": r"__sveltekit|data-sveltekit"}),
    ("Remix", "Framework", {"html": r"__remixContext|__remixManifest"}),
    ("Angular", "Framework", {"html": r'ng-version="|ng-app='}),
    ("React", "JavaScript library", {"scripts": r"react(?:-dom)?(?:\.production)?(?:\.min)?\.js", "html": r"data-reactroot|__REACT_DEVTOOLS|react-dom(?:\.production)?(?:\.min)?\.js"}),
    ("Vue.js", "JavaScript library", {"scripts": r"vue(?:\.runtime)?(?:\.global)?(?:\.prod)?(?:\.min)?\.js", "html": r"data-v-[0-9a-f]{8}|__VUE__"}),
    ("Svelte", "JavaScript library", {"html": r'class="[^"]*svelte-[a-z0-9]{5,}'}),
    ("Alpine.js", "JavaScript library", {"html": r"\sx-data=|alpinejs"}),
    ("htmx", "JavaScript library", {"scripts": r"htmx", "html": r"\shx-(?:get|post|target|swap)="}),
    ("jQuery", "JavaScript library", {"scripts": r"jquery[.-]?(?:\d[\d.]*)?(?:\.min)?\.js"}),
    ("Bootstrap", "JavaScript library", {"html": r"bootstrap(?:\.bundle)?(?:\.min)?\.(?:css|js)"}),
    ("Tailwind CSS", "JavaScript library", {"html": r'tailwindcss|class="[^"]*\b(?:sm|md|lg):(?:flex|grid|hidden|block)\b'}),
    ("Docusaurus", "Static site generator", {"generator": r"docusaurus"}),
    ("Hugo", "Static site generator", {"generator": r"hugo", "version": r"hugo\s*([\d.]+)"}),
    ("Jekyll", "Static site generator", {"generator": r"jekyll"}),
    ("Eleventy", "Static site generator", {"generator": r"eleventy"}),
    ("VitePress", "Static site generator", {"generator": r"vitepress"}),
    ("Laravel", "Framework", {"cookies": r"laravel_session="}),
    ("Django", "Framework", {"cookies": r"csrftoken=", "html": r"csrfmiddlewaretoken"}),
    ("Ruby on Rails", "Framework", {"headers": {"x-runtime": r"^[\d.]+$"}, "html": r'<meta name="csrf-param" content="authenticity_token"'}),
    ("ASP.NET", "Framework", {"headers": {"x-aspnet-version": r".", "x-powered-by": r"asp\.net"}, "cookies": r"ASP\.NET_SessionId", "html": r"__VIEWSTATE"}),
    ("Express", "Framework", {"headers": {"x-powered-by": r"express"}}),
    ("PHP", "Language", {"headers": {"x-powered-by": r"php"}, "cookies": r"PHPSESSID="}),
    ("Google Analytics", "Analytics", {"html": r"""googletagmanager\.com/gtag/js\?id=G-|google-analytics\.com/(?:analytics|ga)\.js|gtag\(['"]config['"],\s*['"]G-"""}),
    ("Google Tag Manager", "Tag manager", {"html": r"googletagmanager\.com/gtm\.js|GTM-[A-Z0-9]{4,}"}),
    ("Plausible", "Analytics", {"html": r"plausible\.io/js"}),
    ("Fathom", "Analytics", {"html": r"cdn\.usefathom\.com"}),
    ("Matomo", "Analytics", {"html": r"matomo\.js|piwik\.js|_paq\.push"}),
    ("Simple Analytics", "Analytics", {"html": r"scripts\.simpleanalyticscdn\.com"}),
    ("Umami", "Analytics", {"html": r"data-website-id=[^>]+umami|umami\.is/script"}),
    ("PostHog", "Analytics", {"html": r"posthog\.init\(|[a-z]+\.posthog\.com/static|posthog-js"}),
    ("Mixpanel", "Analytics", {"html": r"cdn\.mxpnl\.com|mixpanel\.init"}),
    ("Amplitude", "Analytics", {"html": r"cdn\.amplitude\.com|amplitude\.getInstance"}),
    ("Heap", "Analytics", {"html": r"cdn\.heapanalytics\.com"}),
    ("Segment", "Analytics", {"html": r"cdn\.segment\.com/analytics\.js"}),
    ("Hotjar", "Analytics", {"html": r"static\.hotjar\.com|hotjar\.com/c/hotjar-"}),
    ("Microsoft Clarity", "Analytics", {"html": r"clarity\.ms/tag"}),
    ("Vercel Analytics", "Analytics", {"html": r"/_vercel/insights/script\.js|va\.vercel-scripts\.com"}),
    ("Cloudflare Web Analytics", "Analytics", {"html": r"static\.cloudflareinsights\.com/beacon"}),
    ("Adobe Analytics", "Analytics", {"html": r"assets\.adobedtm\.com|s_code\.js|AppMeasurement"}),
    ("Google AdSense", "Advertising", {"html": r"pagead2\.googlesyndication\.com/pagead/js/adsbygoogle"}),
    ("Google Ad Manager", "Advertising", {"html": r"securepubads\.g\.doubleclick\.net"}),
    ("Google Ads", "Advertising", {"html": r"""googleadservices\.com|gtag\(['"]config['"],\s*['"]AW-"""}),
    ("Meta Pixel", "Advertising", {"html": r"""connect\.facebook\.net/[^"']*/fbevents\.js|fbq\(['"]init"""}),
    ("LinkedIn Insight", "Advertising", {"html": r"snap\.licdn\.com/li\.lms-analytics"}),
    ("TikTok Pixel", "Advertising", {"html": r"analytics\.tiktok\.com"}),
    ("X (Twitter) Pixel", "Advertising", {"html": r"static\.ads-twitter\.com"}),
    ("HubSpot", "Marketing", {"html": r"js\.hs-scripts\.com|js\.hsforms\.net"}),
    ("Mailchimp", "Marketing", {"html": r"chimpstatic\.com|list-manage\.com"}),
    ("Klaviyo", "Marketing", {"html": r"static\.klaviyo\.com"}),
    ("Marketo", "Marketing", {"html": r"munchkin\.marketo\.net"}),
    ("Intercom", "Live chat", {"html": r"widget\.intercom\.io|intercomSettings"}),
    ("Drift", "Live chat", {"html": r"js\.driftt\.com"}),
    ("Zendesk", "Live chat", {"html": r"static\.zdassets\.com"}),
    ("Crisp", "Live chat", {"html": r"client\.crisp\.chat"}),
    ("Tawk.to", "Live chat", {"html": r"embed\.tawk\.to"}),
    ("LiveChat", "Live chat", {"html": r"cdn\.livechatinc\.com"}),
    ("Stripe", "Payments", {"html": r"js\.stripe\.com"}),
    ("PayPal", "Payments", {"html": r"paypal\.com/sdk/js|paypalobjects\.com"}),
    ("reCAPTCHA", "Security", {"html": r"google\.com/recaptcha|recaptcha/api\.js"}),
    ("hCaptcha", "Security", {"html": r"hcaptcha\.com/1/api\.js"}),
    ("Cloudflare Turnstile", "Security", {"html": r"challenges\.cloudflare\.com/turnstile"}),
    ("OneTrust", "Consent", {"html": r"cdn\.cookielaw\.org|optanon"}),
    ("Cookiebot", "Consent", {"html": r"consent\.cookiebot\.com"}),
    ("CookieYes", "Consent", {"html": r"cdn-cookieyes\.com"}),
    ("Google Fonts", "Fonts", {"html": r"fonts\.googleapis\.com|fonts\.gstatic\.com"}),
    ("Adobe Fonts", "Fonts", {"html": r"use\.typekit\.net"}),
    ("Font Awesome", "Fonts", {"html": r"font-?awesome(?:\.min)?\.css|kit\.fontawesome\.com|use\.fontawesome\.com"}),
    ("Yoast SEO", "SEO plugin", {"html": r"yoast seo|yoast-schema-graph"}),
    ("Rank Math", "SEO plugin", {"html": r"rank math|rank-math"}),
    ("All in One SEO", "SEO plugin", {"html": r"all in one seo|aioseo"}),
    ("Sentry", "Monitoring", {"html": r"browser\.sentry-cdn\.com|sentry\.io/api|Sentry\.init"}),
    ("New Relic", "Monitoring", {"html": r"js-agent\.newrelic\.com|NREUM"}),
    ("Datadog RUM", "Monitoring", {"html": r"datadoghq-browser-agent|DD_RUM"}),
    ("Optimizely", "A/B testing", {"html": r"cdn\.optimizely\.com"}),
    ("VWO", "A/B testing", {"html": r"dev\.visualwebsiteoptimizer\.com"}),
    ("Cloudflare", "CDN", {"headers": {"cf-ray": r".", "server": r"cloudflare"}}),
    ("Fastly", "CDN", {"headers": {"x-fastly-request-id": r".", "fastly-debug-digest": r".", "x-served-by": r"cache-[a-z]{3}"}}),
    ("Akamai", "CDN", {"headers": {"server": r"akamai", "x-akamai-transformed": r".", "akamai-grn": r"."}}),
    ("Amazon CloudFront", "CDN", {"headers": {"x-amz-cf-id": r".", "via": r"cloudfront"}}),
    ("Bunny CDN", "CDN", {"headers": {"server": r"bunnycdn", "cdn-requestid": r"."}}),
    ("Azure Front Door", "CDN", {"headers": {"x-azure-ref": r"."}}),
    ("Google Cloud CDN", "CDN", {"headers": {"via": r"1\.1 google"}}),
    ("Varnish", "CDN", {"headers": {"x-varnish": r".", "via": r"varnish"}}),
    ("jsDelivr", "CDN", {"html": r"cdn\.jsdelivr\.net"}),
    ("cdnjs", "CDN", {"html": r"cdnjs\.cloudflare\.com"}),
    ("unpkg", "CDN", {"html": r"unpkg\.com"}),
    ("Vercel", "Hosting", {"headers": {"x-vercel-id": r".", "server": r"vercel"}}),
    ("Netlify", "Hosting", {"headers": {"x-nf-request-id": r".", "server": r"netlify"}}),
    ("GitHub Pages", "Hosting", {"headers": {"server": r"github\.com", "x-github-request-id": r"."}}),
    ("Heroku", "Hosting", {"headers": {"via": r"vegur"}}),
    ("Fly.io", "Hosting", {"headers": {"fly-request-id": r".", "server": r"fly/[a-f0-9]+"}}),
    ("Render", "Hosting", {"headers": {"x-render-origin-server": r".", "rndr-id": r"."}}),
    ("Firebase Hosting", "Hosting", {"headers": {"x-firebase-hosting": r"."}}),
    ("Amazon S3", "Hosting", {"headers": {"server": r"amazons3"}}),
    ("WP Engine", "Hosting", {"headers": {"x-powered-by": r"wp engine", "wpe-backend": r"."}}),
    ("Kinsta", "Hosting", {"headers": {"x-kinsta-cache": r"."}}),
    ("Pantheon", "Hosting", {"headers": {"x-pantheon-styx-hostname": r"."}}),
    ("Cloudflare Pages", "Hosting", {"headers": {"cf-pages": r"."}}),
    ("Nginx", "Web server", {"headers": {"server": r"nginx"}}),
    ("Apache", "Web server", {"headers": {"server": r"apache"}}),
    ("LiteSpeed", "Web server", {"headers": {"server": r"litespeed"}}),
    ("Microsoft IIS", "Web server", {"headers": {"server": r"microsoft-iis"}}),
    ("Caddy", "Web server", {"headers": {"server": r"caddy"}}),
    ("OpenResty", "Web server", {"headers": {"server": r"openresty"}}),
    ("Envoy", "Web server", {"headers": {"server": r"envoy", "x-envoy-upstream-service-time": r"."}}),
    ("Google Web Server", "Web server", {"headers": {"server": r"^gws$|^gfe"}}),
]


#: Fewest characters of a literal that is worth looking for.
SHORTEST = 3


def literals(pattern: str) -> list[str]:
    """For each top-level alternative of a pattern its longest run of plain characters, in lower case: what a match must hold. Empty where there is none."""
    found, runs, run, depth, i = [], [], "", 0, 0

    def stop() -> None:
        nonlocal run
        if not depth:
            runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if pattern[i + 1].isalnum():
                stop()
            else:
                run += pattern[i + 1]
            i += 2
            continue
        if c == "[":
            stop()
            i = pattern.index("]", i + 2)
        elif c == "(":
            stop()
            depth += 1
        elif c == ")":
            depth -= 1
            run = ""
        elif c == "|" and not depth:
            stop()
            found.append(max(runs, key=len))
            runs = []
        elif c in "?*{":
            run = run[:-1]
            stop()
            if c == "{":
                i = pattern.index("}", i)
        elif c in ".^$+|":
            stop()
        else:
            run += c
        i += 1
    stop()
    return [x.lower() for x in (*found, max(runs, key=len))]


@lru_cache(maxsize=8)
def _automaton(patterns: tuple[str, ...]):
    """One automaton over the literals of all patterns, the patterns themselves, and those that every text must be searched for."""
    import ahocorasick

    owners: dict[str, set[int]] = {}
    always = set()
    for i, pattern in enumerate(patterns):
        needles = literals(pattern)
        if min(map(len, needles)) < SHORTEST:
            always.add(i)
            continue
        for needle in needles:
            owners.setdefault(needle, set()).add(i)
    automaton = ahocorasick.Automaton()
    for needle, which in owners.items():
        automaton.add_word(needle, frozenset(which))
    if owners:
        automaton.make_automaton()
    # like Java's, the classes and cases of these patterns are those of ASCII
    return automaton if owners else None, [re.compile(p, re.I | re.A) for p in patterns], frozenset(always)


def first_matches(text: str, patterns: tuple[str, ...]) -> dict[int, str]:
    """The first match of each pattern that occurs in a text. One pass finds the literals; only patterns whose literal is there are searched for."""
    automaton, compiled, always = _automaton(patterns)
    likely = set(always)
    if automaton is not None:
        for _, which in automaton.iter(text.lower()):
            likely |= which
    found = {}
    for i in sorted(likely):
        m = compiled[i].search(text)
        if m and m[0]:
            found[i] = m[0]
    return found


def with_matches(pages: DataFrame, patterns: list[str], html: str = "html", out: str = "matches", longest: int = 50) -> DataFrame:
    """The pages without their HTML, with a map from the number of each pattern that occurs to the beginning of its first match."""
    keep = [f for f in pages.schema.fields if f.name != html]
    names, fixed = [f.name for f in keep], tuple(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.int32(), pa.string())
        for batch in batches:
            found = [[(i, m[:longest]) for i, m in first_matches(x.as_py() or "", fixed).items()] for x in batch[html]]
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(found, kind)], [*names, out])

    return pages.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.MapType(T.IntegerType(), T.StringType()))]))


def _evidence(patterns: dict, place: int | None) -> Column:
    """Text of the first evidence in the order headers, generator, cookies, scripts, HTML; null when nothing fits."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in patterns.get("headers", {}).items():
        value = F.element_at("headers", F.lit(name))
        found = found.when(value.rlike("(?i)" + pattern), F.concat(F.lit(f"Header {name}: "), F.substring(value, 1, 60)))
    if "generator" in patterns:
        found = found.when(F.col("generator").rlike("(?i)" + patterns["generator"]), F.concat(F.lit("Generator meta tag: "), F.substring("generator", 1, 60)))
    if "cookies" in patterns:
        found = found.when(F.element_at("headers", F.lit("set-cookie")).rlike("(?i)" + patterns["cookies"]), F.lit("Cookie set by server"))
    if "scripts" in patterns:
        found = found.when(F.col("_scripts").rlike("(?i)" + patterns["scripts"]), F.lit("Script URL"))
    if place is not None:
        found = found.otherwise(F.concat(F.lit("HTML contains “"), F.element_at("_matches", F.lit(place)), F.lit("”")))
    return found


def detect_technologies(pages: DataFrame, *keys: str, signatures=None) -> DataFrame:
    """``(keys, name, category, version, evidence)`` from pages with html, headers, scripts and generator.

    The HTML is read once for the patterns of all signatures; what concerns short columns stays in one projection, and no page is joined with
    the signature table.
    """
    every = signatures or SIGNATURES
    places = {name: i for i, name in enumerate(n for n, _, p in every if "html" in p)}
    staged = with_matches(
        pages.select(*keys, "headers", "generator", F.array_join("scripts", "\n").alias("_scripts"), "html"), [p["html"] for _, _, p in every if "html" in p], out="_matches")
    rows = []
    for name, category, patterns in every:
        version = F.lit(None).cast("string")
        if "version" in patterns:
            version = F.nullif(F.regexp_extract(F.coalesce("generator", F.lit("")), "(?i)" + patterns["version"], 1), F.lit(""))
        rows.append(F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), version.alias("version"), _evidence(patterns, places.get(name)).alias("evidence")))
    hits = F.explode(F.filter(F.array(*rows), lambda r: r["evidence"].isNotNull()))
    return staged.select(*keys, hits.alias("t")).select(*keys, "t.*")
