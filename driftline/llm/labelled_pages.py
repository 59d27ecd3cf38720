"""Pages whose main text is known, from which main_text learns its weights.

Each page is a list of (path of elements, words, is main text). An element is a tag with optional .class or #id marks. The
pages are hand-written layouts; their text is filler, as only structure is learned.
"""

from __future__ import annotations

_MENU = [("nav/ul/li/a", 1, False)] * 6
_TEXT = [("p", 60, True)] * 4


def _in(prefix: str, rows: list) -> list:
    return [(f"{prefix}/{path}", n, main) for path, n, main in rows]


#: The layouts.
LAYOUTS: list[list[tuple[str, int, bool]]] = [
    [*_MENU, ("div.ad", 9, False), *_in("article", [("h1", 8, True), *_TEXT]), ("footer", 10, False)],
    [("header/h2", 4, False), *_in("header", _MENU), *_in("main/article", [("h1", 7, True), ("p.lead", 20, True), *_TEXT, ("h2", 4, True), *_TEXT]), ("aside.sidebar/h3", 2, False), *[("aside.sidebar/ul/li/a", 4, False)] * 5, ("section.comments/h3", 2, False), *[("section.comments/div.comment/p", 18, False)] * 3, ("form.comment-form/label", 2, False), ("footer/p", 12, False)],
    [("div#header/a", 2, False), *[("div#menu/ul/li/a", 2, False)] * 7, *_in("div#content/div.post", [("h1.title", 6, True), *_TEXT, ("ul/li", 9, True), ("ul/li", 9, True), ("ul/li/a", 3, True), ("blockquote/p", 25, True), *_TEXT]), *[("div#sidebar/div.widget/ul/li/a", 3, False)] * 6, *[("div#comments/ol/li/p", 15, False)] * 3, ("div#footer/p", 9, False)],
    [("div.cookie-notice/p", 16, False), ("div.cookie-notice/button", 1, False), *_in("div.navbar", _MENU), *_in("div.container/div.entry-content", [("h1", 9, True), *_TEXT, ("p/a", 3, True), ("div.advert/p", 10, False), *_TEXT, ("table/tr/td", 3, True), ("table/tr/td", 3, True)]), ("div.share/a", 1, False), *[("div.related/ul/li/a", 6, False)] * 4, ("div.copyright", 6, False)],
    [("div.banner/a", 4, False), ("form.search/input", 0, False), ("form.search/button", 1, False), *[("div.breadcrumb/a", 1, False)] * 3, *_in("section.article-body", [("h1", 8, True), ("h2.subtitle", 12, True), *_TEXT, ("figure/figcaption", 12, True), *_TEXT]), ("aside/p", 20, False), ("div.newsletter/p", 12, False), ("form/label", 3, False), ("div.disqus_thread/p", 30, False), ("footer/ul/li/a", 2, False), ("footer/small", 8, False)],
    [("div.top-bar/span", 5, False), *_in("nav.menu", [("a", 1, False)] * 6), *_in("main#main", [("h1", 6, True), *_TEXT, ("ol/li", 12, True), ("ol/li", 12, True), ("pre/code", 20, True), *_TEXT]), *[("div.promo/a", 5, False)] * 2, ("div.alert", 14, False), ("div.popup/p", 12, False), ("footer.site-footer/p", 9, False)],
    [*_MENU, ("div.sponsored/p", 12, False), ("div.notice", 12, False), *_in("article/div", [("h1", 7, True), ("p/b", 12, True), *_TEXT, ("p/a", 2, True), *_TEXT]), *_in("article/aside.sidebar", [("p", 14, False)]), *[("div.responses/div.reply/p", 14, False)] * 3, ("footer/p", 8, False)],
    [("header.masthead/h1", 3, False), *_in("header.masthead", _MENU), *_in("div.story", [("h1.headline", 9, True), ("p.byline", 4, True), *_TEXT, *_TEXT]), ("div.ads/div.ad", 8, False), *[("ul.pagination/li/a", 1, False)] * 4, *[("div.tags/a", 1, False)] * 4, ("div.login/form/label", 2, False), ("div.footer/p", 9, False)],
    [*_MENU, ("section.hero/a", 3, False), *_in("article", [("header/h1", 7, True), ("header/p/span", 4, True), *_TEXT, ("h3", 4, True), ("ul/li/a", 4, True), ("ul/li/a", 4, True), ("p/small", 6, True), ("ol/li/span", 8, True), ("section/h3", 3, True), ("section/p", 40, True)]), *[("section.comments/ul/li/p", 16, False)] * 3, ("footer/div/a", 2, False)],
    [*_in("header/nav", [("ul/li/a", 1, False)] * 5), *_in("main/div", [("h2", 6, True), *_TEXT, ("h3", 3, True), ("ul/li", 9, True), ("ul/li/a", 3, True), ("div/span", 7, True), ("p/label", 3, True), ("ol/li/a", 5, True), *_TEXT]), ("div.sidebar/ul/li", 4, False), ("form/button", 1, False), ("footer/span", 5, False)],
    [("div.gdpr-consent/p", 20, False), ("div.gdpr-consent/button", 2, False), *[("div#topnav/ul/li/a", 2, False)] * 6, *_in("div#page/div.content", [("h1", 7, True), ("figure.image/figcaption", 9, True), *_TEXT]), *[("div.taboola/div/a", 7, False)] * 4, ("div.discussion/h3", 2, False), *[("div.discussion/div.message/p", 22, False)] * 4, ("div#bottom/p", 9, False)],
    [("div.cookie-bar/span", 14, False), *[("ul.navigation/li/a", 1, False)] * 6, *_in("div.wrapper/article.post", [("h1.entry-title", 7, True), ("div.meta/span", 4, True), *_TEXT, ("figure/figcaption", 9, True), ("h2", 4, True), *_TEXT]), *[("div.outbrain/a", 8, False)] * 3, ("div#respond/form/label", 2, False), *[("ol.commentlist/li/article.comment/p", 20, False)] * 3, ("div.widget/h4", 2, False), *[("div.widget/ul/li/a", 3, False)] * 4],
    [("div.consent/p", 18, False), *[("div.megamenu/a", 2, False)] * 8, *_in("main/div.article", [("h1", 7, True), *_TEXT, ("h3", 4, True), ("blockquote", 20, True), *_TEXT, ("h4", 3, True), *_TEXT, ("h5", 3, True), ("h6", 3, True), *_TEXT]), ("div.sponsor/p", 9, False), ("div.adsbygoogle/span", 6, False), ("div.signup/p", 11, False), *[("div.feedback/p", 15, False)] * 3, *[("div.recommendations/a", 7, False)] * 3, ("div.disclaimer/p", 15, False)],
    [("div.notification/p", 12, False), ("div.toolbar/a", 2, False), *_in("article/div.text", [("h1", 7, True), *_TEXT, ("table/tr/th", 2, True), ("table/tr/td", 3, True), ("dl/dt", 2, True), ("dl/dd", 9, True)]), *[("aside/ul/li/a", 4, False)] * 4, *[("div.replies/div/p", 16, False)] * 3, *[("div.trending/ul/li/a", 6, False)] * 4, ("div.footer-links/a", 2, False)],
    [("div.modal/p", 15, False), ("div.subscribe/p", 11, False), *_in("body-main/div", [("h2", 6, True), *_TEXT, ("dl/dt", 2, True), ("dl/dd", 12, True)]), *[("div.social/a", 1, False)] * 4, *[("div.recommended/div/a", 6, False)] * 4, ("div.legal/p", 20, False)],
]


def _element(step: str) -> tuple[str, str]:
    for mark, attribute in ((".", "class"), ("#", "id")):
        if mark in step:
            tag, _, value = step.partition(mark)
            return tag, f' {attribute}="{value}"'
    return step, ""


def labelled_pages() -> list[tuple[str, list[bool]]]:
    """(html, for each block of text in order whether it is main text). Neighbours share the elements they both lie in."""
    out = []
    for layout in LAYOUTS:
        html, labels, open_steps = ["<html><head><title>", "some words of a title", "</title></head><body>"], [False], []
        for path, n, main in layout:
            steps = path.split("/")
            common, own = 0, 1 + (steps[-1] in ("a", "b", "button", "code", "label", "small", "span") and len(steps) > 1)  # an inline one with what it is in
            while common < min(len(steps) - own, len(open_steps)) and steps[common] == open_steps[common]:
                common += 1
            html += [f"</{_element(s)[0]}>" for s in reversed(open_steps[common:])]
            for s in steps[common:]:
                tag, attribute = _element(s)
                html.append(f"<{tag}{attribute}>")
            html.append(" ".join(["word"] * n))
            if n:
                labels.append(main)
            open_steps = steps
        html += [f"</{_element(s)[0]}>" for s in reversed(open_steps)]
        out.append(("".join([*html, "</body></html>"]), labels))
    return out
