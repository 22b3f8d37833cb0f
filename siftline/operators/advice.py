"""Why each check matters, and what to do where it finds something; in our own words."""

from __future__ import annotations

# Which guide explains a check (third entry).
ADVICE: dict[str, tuple[str, str, str | None]] = {
    "http-status": ("Search engines only keep pages that answer with success.", "Make the address answer with status 200, or redirect it to one that does.", None),
    "https": ("Browsers warn about pages that are not encrypted.", "Serve the page over HTTPS and redirect the plain address to it.", None),
    "redirects": ("Every hop costs time and may lose the crawler.", "Link straight to the last address of the chain.", None),
    "robots-meta": ("Directives in the page can keep it out of the index.", "Remove the restricting directive if the page should be found.", "robots-txt"),
    "canonical": ("One address of several like ones should be named as the original.", "Add one canonical link with the full address of the original.", "canonical-url"),
    "robots-txt": ("Crawlers that may not fetch a page can't judge it.", "Change the rule in robots.txt that keeps crawlers from this path.", "robots-txt"),
    "sitemap": ("A sitemap tells crawlers which pages there are.", "List the page in a sitemap and name that in robots.txt.", "xml-sitemap"),
    "language": ("Readers and screen readers rely on the declared language.", "Set the lang attribute of the html element to a valid language code.", None),
    "viewport": ("Without it phones show the page scaled down.", "Add a viewport meta tag with width=device-width and leave zooming on.", None),
    "charset": ("A wrong guess at the encoding garbles text.", "Declare utf-8 at the beginning of the head.", None),
    "favicon": ("The icon marks the page in tabs and results.", "Link an icon in the head.", None),
    "title": ("The title is the headline of the search result.", "Write one title of 20 to 65 characters that says what this page offers.", "title-tag"),
    "meta-description": ("It is often the text below the headline in results.", "Write one description of 70 to 160 characters for this page.", "meta-description"),
    "h1": ("The main heading says what the page is about.", "Give the page one main heading with text.", "h1-tag"),
    "heading-structure": ("Headings in order make a page easy to survey.", "Order headings without gaps between levels and fill or remove empty ones.", "h1-tag"),
    "image-alt": ("Images without a text alternative say nothing to many visitors.", "Describe images that carry meaning; mark the others with an empty alternative.", "image-alt-text"),
    "word-count": ("Very short texts seldom answer a question.", "Say more about the subject, if there is more to say.", None),
    "content-structure": ("Long text without parts is hard to read.", "Break long text up with subheadings and paragraphs.", None),
    "content-rendering": ("Text that only scripts produce may not be seen by crawlers.", "Send the main text in the document itself.", None),
    "internal-links": ("Links within a site lead visitors and crawlers on.", "Link to related pages of the site.", None),
    "external-links": ("Links to other sites put a page in context.", "Link to sources where they help the reader.", None),
    "link-quality": ("Links that say where they lead are of more use.", "Give every link a target and words that describe it.", None),
    "json-ld": ("Structured data can make results richer.", "Mend the blocks that are not valid JSON, and name a type in each.", "schema-markup"),
    "microdata": ("Older forms of structured data are still read.", "Prefer one form of structured data.", "schema-markup"),
    "open-graph": ("Social networks build previews from these tags.", "Add the title, description and image of the preview.", None),
    "twitter-card": ("One network has tags of its own for previews.", "Name a valid card type.", None),
}

CANONICAL_EXAMPLE = '<link rel="canonical" href="{url}">'
TITLE_EXAMPLE = "<title>What this page is about - Name of the site</title>"
VIEWPORT_EXAMPLE = '<meta name="viewport" content="width=device-width, initial-scale=1">'
#: What to do about a finding, and markup to start from ({url}: the page's address), by its message. A
#: warning or error without an entry gets its check's general advice.
FINDINGS: dict[str, tuple[str | None, str | None]] = {
    # technical
    "The page is served without encryption.": ("Serve the page over HTTPS and redirect the plain address to it.", None),
    "One redirect, declared temporary.": ("If the page has moved for good, answer with 301 instead, so that the new address takes over from the old one.", None),
    "One redirect.": ("Nothing needs to be done; a link straight to the last address would save a round trip.", None),
    "The page asks not to be indexed.": ("If the page should be found, take noindex (or none) out of its robots directives and headers.", '<meta name="robots" content="index, follow">'),
    "The page asks that its links are not followed.": ("Remove nofollow for the page as a whole and mark single links instead.", None),
    "Indexable, with rules for its display.": ("Nothing needs to be done if these limits on snippets, previews or copies are meant.", None),
    "No canonical address is declared.": ("Name the address by which this page should be known in one canonical link.", CANONICAL_EXAMPLE),
    "Several canonical addresses are declared.": ("Keep one canonical link and remove the others; templates and plugins often add one each.", None),
    "The canonical address is empty.": ("Fill in the page's full address, or remove the link.", CANONICAL_EXAMPLE),
    "The canonical address is no valid URL.": ("Replace it by a full address that begins with https.", CANONICAL_EXAMPLE),
    "The canonical address is relative.": ("Write the address out in full, so that copies elsewhere still point here.", CANONICAL_EXAMPLE),
    "There is no robots.txt.": ("None is needed; one helps to keep crawlers out of parts of a site or to name its sitemap.", None),
    "robots.txt seems to block the page.": ("Change or remove the rule if crawlers should read this page.", None),
    "A pattern of robots.txt may cover the page.": ("Test the address against the file with a search engine's own tool.", None),
    "No sitemap was found.": ("If there is one, name it in robots.txt; if not, most site software can write one.", None),
    "A sitemap index was found.": ("Its parts were not read: look there whether this page is listed.", None),
    "The sitemap does not list the page.": ("List the page if it should be found, and see that its address is written alike there.", None),
    "The document declares no language.": ("Set the lang attribute of the html element.", '<html lang="en">'),
    "The declared language is no usual code.": ("Use a language code, and a region after a hyphen where it matters.", '<html lang="en-GB">'),
    "No viewport is declared.": ("Add a viewport meta tag, or phones show the page scaled down.", VIEWPORT_EXAMPLE),
    "The viewport does not follow the device's width.": ("Let the width follow the device instead of fixing it.", VIEWPORT_EXAMPLE),
    "The viewport prevents zooming.": ("Leave zooming on: many readers need it.", VIEWPORT_EXAMPLE),
    "No character encoding is declared.": ("Declare the encoding at the beginning of the head.", '<meta charset="utf-8">'),
    "The encoding is not UTF-8.": ("Other encodings work, but UTF-8 holds every language and is what tools expect.", '<meta charset="utf-8">'),
    "No icon is declared.": ("Link an icon in the head, if there isn't one at the usual place.", '<link rel="icon" href="/favicon.ico" sizes="any">'),
    # on-page
    "The page has no title.": ("Give the page a title of its own.", TITLE_EXAMPLE),
    "The title is empty.": ("Write a title that says what the page is about.", TITLE_EXAMPLE),
    "The page has several titles.": ("Keep one title in the head; results may show any of them.", None),
    "The title is short.": ("Say more in the title: what the page offers, and whose it is.", None),
    "The title is very long.": ("Cut the title to what matters; its end will not be shown.", None),
    "The title is long.": ("Put the important words first, as the end may be cut off.", None),
    "There is no meta description.": ("Sum the page up in a sentence or two.", '<meta name="description" content="What a reader will find on this page.">'),
    "The meta description is empty.": ("Fill in a summary of the page, or remove the tag.", None),
    "There are several meta descriptions.": ("Keep one meta description.", None),
    "The meta description is short.": ("Use the room there is: up to 160 characters are usually shown.", None),
    "The meta description is very long.": ("Cut it to about 160 characters; the rest is not shown.", None),
    "The meta description is longer than most results show.": ("Nothing needs to be done, but let the important words come first.", None),
    "There is no H1.": ("Add one main heading that names the subject.", "<h1>What this page is about</h1>"),
    "Every H1 is empty.": ("Put text into the main heading; an image needs an alternative text.", None),
    "There are several H1.": ("They are allowed, but one main heading is clearer: make the others H2.", None),
    "There are no headings.": ("Divide the text by headings.", None),
    "Headings are empty.": ("Fill empty headings or remove them.", None),
    "Heading levels are skipped.": ("Go down one level at a time, and choose sizes by style.", None),
    "Images lack alt attributes.": ("Describe images that carry meaning; mark the others with an empty alternative.", '<img src="chart.png" alt="Sales by month">'),
    # content
    "A long text has no subheadings.": ("Break the text up with subheadings.", None),
    "A very long text has few subheadings.": ("Add subheadings, so that readers find their part.", None),
    "The text has no paragraphs.": ("Put paragraphs into p elements instead of line breaks.", None),
    "Much markup with little text: probably rendered by scripts.": ("Send the main text in the document itself, or render it on the server.", None),
    # links
    "The page links to no other page of its site.": ("Link to related pages of the site.", None),
    "Every internal link is nofollow.": ("Take nofollow off the site's own links.", None),
    "Links open new tabs without noopener.": ("Add noopener to links that open a new tab; browsers now do so themselves.", '<a href="https://example.com/" target="_blank" rel="noopener">Example</a>'),
    "Links lack destinations or descriptive texts.": ("Give each link a target and words that say where it leads, and use buttons for actions.", None),
    # structured data
    "There is no JSON-LD.": ("It is optional, and most use for articles, products, events and the like.", '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Article", "headline": "..."}</script>'),
    "No JSON-LD block is valid JSON.": ("Mend the blocks: a comma too many or a missing quote is the usual cause.", None),
    "JSON-LD blocks are not valid JSON.": ("Mend the blocks that are not valid; the others are still read.", None),
    "JSON-LD declares no type.": ("Name an @type in each block.", None),
    # social
    "There is no Open Graph metadata.": ("Add at least title, description and image of the preview.", '<meta property="og:title" content="..."><meta property="og:description" content="..."><meta property="og:image" content="https://example.com/preview.jpg">'),
    "There is no card, but Open Graph serves in its place.": ("Nothing needs to be done, unless this preview should differ.", '<meta name="twitter:card" content="summary_large_image">'),
    "There is no card and nothing in its place.": ("Name a card type, or add Open Graph tags.", '<meta name="twitter:card" content="summary_large_image">'),
    "The card has no type.": ("Name the card's type.", '<meta name="twitter:card" content="summary">'),
    "The card's type is unknown.": ("Use summary, summary_large_image, app or player.", None),
}

# Guides by slug, and labels with tones of statuses and severities.
GUIDES = tuple(sorted({g for _, _, g in ADVICE.values() if g}))
GUIDE_TITLES = (
    ("title-tag", "What is a title tag?", "2026-01-10"), ("meta-description", "What is a meta description?", "2026-01-10"), ("h1-tag", "What is an H1 tag?", "2026-01-10"), ("canonical-url", "What is a canonical URL?", "2026-01-10"),
    ("robots-txt", "What is robots.txt?", "2026-01-10"), ("xml-sitemap", "What is an XML sitemap?", "2026-01-10"), ("schema-markup", "What is schema markup?", "2026-01-10"), ("image-alt-text", "What is image alt text?", "2026-01-10"),
)
STATUS_LABELS = (("PASS", "Pass", "success"), ("WARNING", "Warning", "warning"), ("ERROR", "Error", "danger"), ("INFO", "Info", "info"), ("UNAVAILABLE", "Unavailable", "neutral"))
SEVERITY_LABELS = (("CRITICAL", "Critical", "danger"), ("HIGH", "High priority", "danger"), ("MEDIUM", "Medium", "warning"), ("LOW", "Low", "warning"), ("INFO", "Informational", "neutral"))


def guide_dim(spark):
    """Guides as rows (guide, guide_title, updated)."""
    return spark.createDataFrame(list(GUIDE_TITLES), "guide string, guide_title string, updated string")


def with_guides(results):
    """Check results with the title and date of the guide that explains them, if there is one; eight rows are broadcast."""
    from pyspark.sql import functions as F

    return results.join(F.broadcast(guide_dim(results.sparkSession)), "guide", "left")
