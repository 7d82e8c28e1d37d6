"""Links, labels and span charts."""

from __future__ import annotations

import hashlib

from arbora.render.tables import Html, escape

WIDTH = 1000


def link(url: str | None, label, hint: str | None = None, style: str | None = None) -> Html:
    """An anchor; a plain span without address, a tooltip by hint with an id from its content."""
    look = f' style="{escape(style)}"' if style else ""
    tip = f' title="{escape(hint)}" id="t{hashlib.md5(f"{url}{label}{hint}".encode()).hexdigest()[:8]}"' if hint else ""
    tag = f'a href="{escape(url)}"' if url else "span"
    return Html(f"<{tag}{look}{tip}>{escape(label)}</{tag.split()[0]}>")


def auto_color(label: str) -> str:
    return "#" + hashlib.md5(label.encode()).hexdigest()[:6]


def _span(width: float, color: str, label: str) -> str:
    return f'<span style="display:inline-block;width:{round(width)}px;background:{color}" title="{escape(label)}">&nbsp;</span>'


def barchart(series: dict[str, float], scale: float = 1.0, colors: dict[str, str] | None = None) -> Html:
    """Bars beside each other, at most 1000 units in all."""
    most = sum(max(0, v or 0) for v in series.values()) * scale
    fit = scale * min(1.0, WIDTH / most) if most else scale
    bars = "".join(_span((v or 0) * fit, (colors or {}).get(k) or auto_color(k), f"{k}: {v}") for k, v in series.items())
    return Html(bars, sum(v or 0 for v in series.values()))


def linechart(series: dict[str, float], scale: float = 1.0, colors: dict[str, str] | None = None) -> Html:
    """Marks over one axis, each as far as its value."""
    out = []
    for k, v in series.items():
        at = min(WIDTH, (v or 0) * scale)
        out.append(f'<span style="position:absolute;left:{round(at)}px;color:{(colors or {}).get(k) or auto_color(k)}" title="{escape(f"{k}: {v}")}">|</span>')
    return Html(f'<span style="position:relative">{"".join(out)}</span>', sum(v or 0 for v in series.values()))
