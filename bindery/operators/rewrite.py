"""Content rewriting: paths in markup and an injected stylesheet. Everything else is copied byte for byte."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import href

# Attributes with paths, by tag.
PATHS = {
    "object": ("data",),
    "source": ("src", "srcset"),
    "link": ("href",),
    "image": ("href", "xlink:href"),
    "use": ("href", "xlink:href"),
    "iframe": ("src",),
    "script": ("src",),
    "img": ("src",),
    "video": ("src",),
    "audio": ("src",),
    "track": ("src",),
    "input": ("src",),
    "a": ("href",),
}
_SKIP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>", re.S)
_TOKEN = re.compile(rf"{_SKIP.pattern}|<(?P<tag>[^\s/>!?]+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?P<name>[^\s=/]+)(?P<mid>\s*=\s*)(?P<q>[\"'])(?P<value>.*?)(?P=q)", re.S)
_SCHEME = re.compile("[A-Za-z][A-Za-z0-9+.-]*:")


def _normal(path: str) -> str:
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            del out[-1:]
        elif part not in ("", "."):
            out.append(part)
    return "/" * path.startswith("/") + "/".join(out)


def _resolved(base: str, value: str, prefix: str) -> str:
    path = value if value.startswith("/") else _normal(f"{base}/{value}")
    return path if prefix == "/" else prefix + path[1:]


def rewrite_markup(html: str, base: str, prefix: str | None, css: str | None) -> str:
    """base: the directory of the file; prefix: what stands for the root in paths (None: paths stay); css: before </head>."""
    if prefix is not None:

        def tag(m: re.Match) -> str:
            names = PATHS.get(m["tag"] or "")
            if not names:
                return m[0]

            def attribute(a: re.Match) -> str:
                v = a["value"]
                if a["name"] not in names or _SCHEME.match(v) or m["tag"] == "a" and v.startswith("#"):
                    return a[0]
                return f"{a['name']}{a['mid']}{a['q']}{_resolved(base, v, prefix)}{a['q']}"

            return f"<{m['tag']}{_ATTRIBUTE.sub(attribute, m['rest'])}>"

        html = _TOKEN.sub(tag, html)
    if css is not None:
        html = re.sub(r"</head(?=\s*>)", lambda m: f"<style>/*<![CDATA[*/{css}/*]]>*/</style>{m[0]}", html)
    return html


def rewritten(content: Column, location: Column, prefix: str | None = None, css: str | None = None) -> Column:
    """``content`` of the file at ``location``; with neither option the column itself, and for css alone a native replacement."""
    if prefix is None and css is None:
        return content
    if prefix is None:
        style = f"<style>/*<![CDATA[*/{css}/*]]>*/</style>".replace("\\", "\\\\").replace("$", "\\$")
        return F.regexp_replace(content, F.lit(r"(</head\s*>)"), F.lit(style + "$1"))

    @F.pandas_udf(StringType())
    def run(html: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([None if h is None else rewrite_markup(h, b or "", prefix, css) for h, b in zip(html, base, strict=True)])

    return run(content, href.parent_text(location))
