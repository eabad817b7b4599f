"""A small Markdown renderer for notes: raw HTML is shown as text, images become their alt text, and only safe links link."""

from __future__ import annotations

import html
import re

SAFE = ("http", "https", "mailto")


def safe_link(url: str) -> str | None:
    """The link if it is relative, an anchor, or of an allowed scheme."""
    url = url.strip()
    scheme = re.match(r"[^/]*?:", url)
    if not url or (scheme and url[: scheme.end() - 1].lower() not in SAFE):
        return None
    return url


def inline(text: str) -> str:
    text = html.escape(text, quote=True)
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text)

    def link(m: re.Match) -> str:
        to = safe_link(html.unescape(m.group(2)))
        return f'<a href="{html.escape(to, quote=True)}">{m.group(1)}</a>' if to else m.group(1)

    text = re.sub(r"\[([^\]]*)\]\(([^)\s]*)[^)]*\)", link, text)
    text = re.sub(r"`([^`]+)`", r"<code>\1</code>", text)
    text = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", text)
    return re.sub(r"(?<![\w*])\*([^*\s][^*]*)\*", r"<em>\1</em>", text)


def render(md: str) -> str:
    out: list[str] = []
    for block in re.split(r"\n\s*\n", md.strip()):
        lines = block.split("\n")
        head = re.match(r"(#{1,6})\s+(.*)", lines[0])
        if head and len(lines) == 1:
            n = len(head.group(1))
            out.append(f"<h{n}>{inline(head.group(2))}</h{n}>")
        elif all(re.match(r"\s*[-*+]\s+", x) for x in lines):
            items = "".join(f"<li>{inline(re.sub(r'^\s*[-*+]\s+', '', x))}</li>" for x in lines)
            out.append(f"<ul>{items}</ul>")
        elif all(re.match(r"\s*\d+[.)]\s+", x) for x in lines):
            items = "".join(f"<li>{inline(re.sub(r'^\s*\d+[.)]\s+', '', x))}</li>" for x in lines)
            out.append(f"<ol>{items}</ol>")
        elif all(x.startswith(">") for x in lines):
            out.append(f"<blockquote><p>{inline(' '.join(x[1:].strip() for x in lines))}</p></blockquote>")
        elif block:
            out.append(f"<p>{inline(chr(10).join(lines))}</p>")
    return "\n".join(out)
