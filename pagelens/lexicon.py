"""Fixed values that results depend on: word lists, weights, entities, limits."""

# Words that no phrase may hold. Straight apostrophes only.
STOPWORDS = frozenset("""a about above after again against all am an and any are aren't as at be
because been before being below between both but by can cannot could couldn't did didn't do does doesn't
doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll
he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's
its itself let's me more most mustn't my myself no nor not of off on once only or other ought our ours
ourselves out over own same shan't she she'd she'll she's should shouldn't so some such than that that's the
their theirs them themselves then there there's these they they'd they'll they're they've this those through
to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where
where's which while who who's whom why why's with won't would wouldn't you you'd you'll you're you've your
yours yourself yourselves also just get got make made use used using new one two three via etc via per within
across upon many much may might must shall will since however therefore thus able need needs want wants
like likes back even still yet ever never always often sometimes really quite rather every another anything
something nothing everything someone anyone everyone else than then now today yesterday tomorrow here there
click read more learn find see view go home page site website www com http https html""".split())
# Tokens without a topic.
JUNK = ("px", "em", "rem", "div", "span", "href", "src", "utm", "nbsp", "amp", "lorem", "ipsum")
# Site furniture, never recommended.
BOILERPLATE = (
    "welcome", "home", "homepage", "about", "about us", "contact", "contact us", "menu", "navigation", "nav", "toggle", "skip", "search", "login", "log in", "logout", "sign in",
    "sign up", "signup", "register", "subscribe", "newsletter", "copyright", "rights reserved", "all rights", "privacy", "privacy policy", "terms", "terms of service", "cookie", "cookies",
    "cookie policy", "sitemap", "back to top", "read more", "learn more", "click here", "main content", "skip to content", "follow us", "share", "print", "email us", "faq",
    "page", "website", "site", "welcome to",
)
# Named entities.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "copy": "©", "reg": "®",
    "trade": "™", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "uuml": "ü", "ouml": "ö", "auml": "ä", "szlig": "ß", "middot": "·", "bull": "•", "laquo": "«", "raquo": "»", "deg": "°", "euro": "€",
    "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "para": "¶", "dagger": "†", "permil": "‰", "prime": "′",
}
# Field weights in tenths, in field order.
FIELDS = {"title": 60, "h1": 50, "description": 35, "h2": 25, "h3": 18, "anchor": 14, "alt": 12, "body": 10}
# Characters that end a segment, and that can be part of a token.
SEGMENT_BREAKS = r"""[.!?;:,()\[\]{}"“”„«»|/\\<>•·—–\n\r\t~^*+=@#$%&]+"""
TOKEN_BREAKS = "[^a-z0-9'’-]+"
#: White space as the audited pages' own scripts see it.
BLANKS = "\t\n\x0b\f\r                  　﻿"
BLANK = f"[{BLANKS}]"
# Limits of one analysis.
MAX_VOCAB, MAX_CLUSTERED, DIMS, MIN_PHRASENESS, MIN_PHRASE_COUNT, NOISE = 400, 180, 160, 0.28, 2, 0.04
MAX_BODY, MAX_HEADING, MAX_LABEL, MAX_HEADINGS, MAX_LABELS, MAX_HOSTS = 40_000, 300, 120, 401, 601, 40
CONTENTLESS = ("script", "style", "noscript", "svg", "template")
CHROME = ("nav", "footer", "header", "aside", "form", "pre", "code", "kbd", "samp")
# Labels that say nothing about the link.
GENERIC_LABELS = ("click here", "read more", "here", "more", "link", "this", "learn more")
