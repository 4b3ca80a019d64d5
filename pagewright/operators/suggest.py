"""Suggestions by template for issues that a template can mend, and which of them may be applied without asking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# What is suggested for each issue type. {name} and {site} are the site's name and address, {domain} the address without
# a slash at its end, {url} the page's address without query and fragment, {slug} the last part of its path, {label} that part in
# words, {keyword} and {Keyword} the issue's search term as it is and with capitals.
ORGANIZATION = '{\n  "@context": "https://schema.org",\n  "@type": "Organization",\n  "name": "{name}",\n  "url": "{site}",\n  "logo": "{domain}/logo.png",\n  "sameAs": [\n    "{domain}/about"\n  ]\n}'
ORGANIZATION_PROFILES = '{\n  "@context": "https://schema.org",\n  "@type": "Organization",\n  "name": "{name}",\n  "url": "{site}",\n  "logo": "{domain}/icon-512.png",\n  "sameAs": [\n    "{domain}/impressum"\n  ]\n}'
HEADERS = """# /etc/nginx/snippets/security-headers.conf
add_header Strict-Transport-Security "max-age=63072000; includeSubDomains; preload" always;
add_header X-Frame-Options "SAMEORIGIN" always;
add_header X-Content-Type-Options "nosniff" always;
add_header Referrer-Policy "strict-origin-when-cross-origin" always;
add_header Permissions-Policy "camera=(), microphone=(), geolocation=()" always;
"""
_DESCRIPTION = "{name} — entdecke unser Angebot. Persoenlich, transparent, DSGVO-konform. Jetzt mehr erfahren auf {site}."
TEMPLATES = {
    "missing_title": "{name} | {label}",
    "short_title": "{name} | {label}",
    "long_title": "Shorten to: {name} | {slug}",
    "missing_meta_description": _DESCRIPTION,
    "short_meta_description": _DESCRIPTION,
    "long_meta_description": "Shorten current description to 140-160 characters.",
    "missing_h1": "{name}",
    "missing_canonical": "{url}",
    "canonical_missing": "{url}",
    "missing_og_image": "{domain}/og-image.webp",
    "missing_organization_schema": ORGANIZATION,
    "org_schema_no_sameas": ORGANIZATION_PROFILES,
    "missing_robots_txt": "User-agent: *\nAllow: /\nDisallow: /api/\n\nSitemap: {domain}/sitemap.xml\n",
    "missing_sitemap_xml": '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n  <url><loc>{site}</loc><priority>1.0</priority></url>\n</urlset>\n',
    "sitemap_no_lastmod": "Add <lastmod>YYYY-MM-DD</lastmod> to each <url> entry in sitemap.xml.",
    "missing_security_headers": HEADERS,
    "missing_contact_page": "Erstelle eine Kontakt-Page unter {domain}/kontakt mit Adresse, Email-Kontakt und 1-2 Absaetzen ueber {name}. Verlinke sie aus der Hauptnavigation.",
    "missing_about_page": "Erstelle eine Ueber uns-Page unter {domain}/about mit Adresse, Email-Kontakt und 1-2 Absaetzen ueber {name}. Verlinke sie aus der Hauptnavigation.",
    "low_ctr_opportunity": "Title: {Keyword} | {name}\nDescription: Alles über {keyword} bei {name}. Kostenlose Erstberatung, 20+ Jahre Erfahrung.",
}
#: Suggestions that are cut, fixes that go by another type, and by another address than the page's.
CUT = {"missing_meta_description": 160, "short_meta_description": 160}
FIX_TYPE = {"missing_canonical": "canonical_missing", "org_schema_no_sameas": "missing_organization_schema"}
FIX_URL = {"missing_og_image": "{domain}/og-image.webp", "missing_organization_schema": "{site}", "org_schema_no_sameas": "{site}", "missing_security_headers": "nginx config", "missing_canonical": "{url}", "canonical_missing": "{url}"}


def _pick(values: dict, default=None):
    if not values:
        return F.lit(default)
    got = F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("type"))
    return got if default is None else F.coalesce(got, F.lit(default))


def suggestions(issues: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """``issues(type, affected_url, name, domain, ...)`` that have a template, with slug, label and suggestion. An issue without an address is its domain's;
    a label begins each word with a capital, and is Home where the path ends in nothing. A column ``keyword`` is taken if there is one."""
    known = TEMPLATES if templates is None else templates
    if not known:
        return issues.withColumns({c: F.lit(None).cast("string") for c in ("slug", "label", "suggestion")}).limit(0)
    domain = F.regexp_replace("domain", "/+$", "")
    page = F.coalesce(F.nullif(F.col("affected_url"), F.lit("")), F.col("domain"))
    slug = F.regexp_extract(F.regexp_replace(page, "/+$", ""), "[^/]*$", 0)
    label = F.coalesce(F.nullif(tx.title_case(F.replace(slug, F.lit("-"), F.lit(" "))), F.lit("")), F.lit("Home"))
    keyword = F.col("keyword") if "keyword" in issues.columns else F.lit("")
    text = F.substring(_pick(known), 1, 1_000_000)
    marks = (("{name}", F.col("name")), ("{site}", F.col("domain")), ("{domain}", domain), ("{url}", F.regexp_replace(page, "(?s)[#?].*$", "")), ("{slug}", slug), ("{label}", label), ("{keyword}", keyword), ("{Keyword}", tx.title_case(keyword)))
    for mark, value in marks:
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("")))
    text = F.substring(text, F.lit(1), _pick(CUT, 1_000_000))
    return issues.withColumns({"slug": slug, "label": label, "suggestion": text}).filter("suggestion IS NOT NULL")


def template_fixes(issues: DataFrame) -> DataFrame:
    """Fixes by template: source, type, url, issue_title, suggestion and priority, as an applier takes them. ``issues`` as for
    ``suggestions``, with severity and title."""
    d = suggestions(issues)
    domain = F.regexp_replace("domain", "/+$", "")
    page = F.coalesce(F.nullif(F.col("affected_url"), F.lit("")), F.col("domain"))
    url = F.coalesce(_pick(FIX_URL), page)
    for mark, value in (("{domain}", domain), ("{site}", F.col("domain")), ("{url}", F.regexp_replace(page, "(?s)[#?].*$", ""))):
        url = F.replace(url, F.lit(mark), value)
    title = F.col("title") if "title" in issues.columns else F.lit(None).cast("string")
    return d.select(F.lit("template").alias("source"), F.coalesce(_pick(FIX_TYPE), F.col("type")).alias("type"), url.alias("url"), title.alias("issue_title"), "suggestion", F.coalesce("severity", F.lit("medium")).alias("priority"))


def general_fixes(sites: DataFrame) -> DataFrame:
    """The two fixes that every site (``sites(name, domain)``) gets: an organisation block and security headers."""
    two = sites.select("name", "domain", F.explode(F.array(F.lit("missing_organization_schema"), F.lit("missing_security_headers"))).alias("type"), F.lit(None).cast("string").alias("affected_url"), F.lit("medium").alias("severity"))
    return template_fixes(two.withColumn("title", F.when(F.col("type") == "missing_organization_schema", "Organization schema snippet").otherwise("Security headers snippet")))


#: What a model is asked for, by issue type; the marks are those of templates, and the issue's own columns.
_TITLE_QUESTION = "Schreibe einen optimalen HTML <title> (50-60 Zeichen, deutsch) für die Seite {url} der Marke '{name}' ({site}). Gib NUR den Titel-Text aus, keine Erklärung, keine Anführungszeichen."
_DESCRIPTION_QUESTION = "Schreibe eine optimale Meta-Description (140-160 Zeichen, deutsch) für {url} von '{name}'. Enthalte Call-to-Action. Gib NUR den reinen Text aus."
QUESTIONS = {
    "missing_title": _TITLE_QUESTION, "short_title": _TITLE_QUESTION, "long_title": _TITLE_QUESTION,
    "missing_meta_description": _DESCRIPTION_QUESTION, "short_meta_description": _DESCRIPTION_QUESTION, "long_meta_description": _DESCRIPTION_QUESTION,
    "missing_h1": "Schlage einen H1-Text (3-8 Wörter, deutsch) für {url} von '{name}' vor. Nur der H1-Text, nichts anderes.",
    "low_ctr_opportunity": "Für den Suchbegriff '{keyword}' rankt '{name}' ({site}). Schlage einen neuen Page-Title UND eine neue Meta-Description vor, die die CTR erhöhen. Format:\nTITLE: ...\nDESC: ...",
    "striking_distance": "Die Seite rankt für '{keyword}'. Liste 5 konkrete on-page SEO-Maßnahmen für '{name}' auf, um auf Seite 1 zu kommen. Kurz und konkret, nummeriert.",
    "missing_organization_schema": "Erzeuge einen vollständigen schema.org Organization JSON-LD Block für '{name}' ({site}). Gib nur den JSON-Block aus.",
}
OTHER_QUESTION = "SEO-Problem: {type}. Marke: {name}, URL: {url}. Gib eine kurze, umsetzbare Empfehlung in maximal 3 Sätzen."


def questions(issues: DataFrame) -> DataFrame:
    """``issues`` with the question that a model is asked for a fix, as ``prompt``."""
    page = F.coalesce(F.nullif(F.col("affected_url"), F.lit("")), F.col("domain"))
    keyword = F.col("keyword") if "keyword" in issues.columns else F.lit("")
    text = _pick(QUESTIONS, OTHER_QUESTION)
    for mark, value in (("{name}", F.col("name")), ("{site}", F.col("domain")), ("{url}", page), ("{keyword}", keyword), ("{type}", F.col("type"))):
        text = F.replace(text, F.lit(mark), F.coalesce(value, F.lit("")))
    return issues.withColumn("prompt", text)


def applicable(fixes: DataFrame, allowed: tuple[str, ...], also: tuple[str, ...] = ()) -> DataFrame:
    """The fixes of allowed types that are not of low priority."""
    return fixes.filter(F.col("type").isin(*dict.fromkeys([*allowed, *also])) & (F.coalesce("priority", "severity", F.lit("low")) != "low"))
