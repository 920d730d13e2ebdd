"""Log-odds that a block of text in an element tree is boilerplate: a logistic regression on a labelled sample.

Features of a block (the text of one innermost block element): the share of its letters inside links, its length, the
share of little words, whether it ends as a sentence, and whether elements around it name boilerplate or content.
The sample is SAMPLE below, its rows are the bound of the fit; the weights come out of it by Newton's method.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Elements that hold a block of text, that have no end, and that end the one of their kind before them (fixed values).
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header legend li main menu nav ol option p section select summary table td th tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = frozenset("li dt dd p td th tr option".split())
#: Elements that name boilerplate or content, and names of classes and ids that do (fixed values).
_AWAY = frozenset("nav footer aside menu form fieldset button select dialog".split())
_KEEP = frozenset("p article main blockquote pre h1 h2 h3 h4 h5 h6 td th caption figcaption dd".split())
_AWAY_NAMES = re.compile(r"(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(?:nav\w*|menu\w*|footer|sidebar|breadcrumbs?|cookie\w*|share|social|related|comments?|advert\w*|ads?|promo|banner|pagination|login|newsletter)\b", re.IGNORECASE)
_KEEP_NAMES = re.compile(r"(?:class|id|role)\s*=\s*[\"']?[^\"'>]*\b(?:content|article|post|entry|main|story)\b", re.IGNORECASE)
#: Little words of English, German and French (fixed values); of Japanese the particles count instead.
_LITTLE = frozenset(
    "a an the of to in on at by for and or is are was were be it he she this that with from as not but his her its they we you had has have which who der die das ein eine und ist im von zu mit auf den dem des nicht sich "
    "als auch es wurde war le la les un une et est en dans que qui pour sur au aux ce ne pas il elle du par plus fut".split()
)
_PARTICLES = re.compile(r"[はがをにでとのもへや]")
_WORD = re.compile(r"[^\W\d_]+")
_CJK = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")
_END = re.compile(r"[.!?。！？…:][\"”“»」)）]*\s*$")
#: Most that the classifier alone may say.
BOUND = 4.0


def role(name: str, attributes: str) -> int:
    """-1 for an element that names boilerplate, 1 for one that names content, 0 for neither."""
    if name in _AWAY or attributes and _AWAY_NAMES.search(attributes):
        return -1
    return int(name in _KEEP or bool(attributes and _KEEP_NAMES.search(attributes)))


@dataclass
class Block:
    """The text of one block: whether boilerplate or content is named around it, its runs and the letters in links."""

    away: bool
    keep: bool
    runs: list[str] = field(default_factory=list)
    linked: int = 0

    def add(self, run: str, link: bool) -> None:
        self.runs.append(run)
        self.linked += len(run.strip()) if link else 0


def features(block: Block) -> np.ndarray:
    text = " ".join(block.runs)
    letters = sum(len(r.strip()) for r in block.runs)
    words = _WORD.findall(text)
    cjk = len(_CJK.findall(text))
    little = len(_PARTICLES.findall(text)) / cjk * 2 if cjk > letters / 2 else sum(w.lower() in _LITTLE for w in words) / max(1, len(words))
    length = np.log2(1 + (3 * letters if cjk > letters / 2 else letters)) / 8
    return np.array([1.0, block.linked / max(1, letters), length, min(1.0, little), float(bool(_END.search(text))), float(block.away), float(block.keep)])


#: Labelled blocks: text, linked, boilerplate named around, content named around, whether it is boilerplate.
SAMPLE = [
    ("Home", 1, 1, 0, 1), ("Products", 1, 1, 0, 1), ("Log in", 1, 1, 0, 1), ("Contact us", 1, 1, 0, 1), ("About", 1, 0, 0, 1), ("Subscribe to our newsletter", 1, 1, 0, 1),
    ("Privacy policy", 1, 1, 0, 1), ("Terms of use", 1, 1, 0, 1), ("All rights reserved.", 0, 1, 0, 1), ("Copyright 2019 Example Ltd.", 0, 1, 0, 1), ("Share this article", 0, 1, 0, 1), ("Next page", 1, 0, 0, 1),
    ("Sign up now", 1, 0, 0, 1), ("We use cookies to improve our site.", 0, 1, 0, 1), ("Related: ten more stories", 1, 1, 0, 1), ("Read more", 1, 0, 0, 1), ("Back to top", 1, 0, 0, 1), ("Powered by Example", 1, 1, 0, 1),
    ("Startseite", 1, 1, 0, 1), ("Impressum", 1, 1, 0, 1), ("Datenschutz", 1, 1, 0, 1), ("Kontakt", 1, 0, 0, 1), ("Alle Rechte vorbehalten.", 0, 1, 0, 1), ("Anmelden", 1, 1, 0, 1), ("Zum Seitenanfang", 1, 0, 0, 1),
    ("Accueil", 1, 1, 0, 1), ("Mentions légales", 1, 1, 0, 1), ("Se connecter", 1, 1, 0, 1), ("Tous droits réservés.", 0, 1, 0, 1), ("Plan du site", 1, 0, 0, 1), ("Lire la suite", 1, 0, 0, 1),
    ("ホーム", 1, 1, 0, 1), ("ログイン", 1, 1, 0, 1), ("お問い合わせ", 1, 1, 0, 1), ("利用規約", 1, 1, 0, 1), ("次のページ", 1, 0, 0, 1), ("All rights reserved.", 0, 1, 1, 1), ("Follow us on the web", 1, 1, 1, 1),
    ("The river rises in the hills and flows past the old town to the sea.", 0, 0, 1, 0), ("History", 0, 0, 1, 0), ("The mill was rebuilt in 1809 and kept its name.", 0, 0, 1, 0), ("Population: 3000", 0, 0, 1, 0),
    ("See also the article on mills for a longer account of the matter.", 0, 0, 1, 0), ("first step", 0, 0, 0, 0), ("Mix the flour with the milk.", 0, 0, 0, 0), ("12", 0, 0, 1, 0), ("Area", 0, 0, 1, 0), ("A short note on the dialect", 0, 0, 0, 0),
    ("a stone bridge", 0, 0, 0, 0), ("collect the entries", 0, 0, 0, 0), ("Sources", 0, 0, 1, 0), ("Geography", 0, 0, 1, 0), ("The guild sold 766 pieces of cloth every autumn.", 0, 0, 0, 0), ("See the list of rivers", 1, 0, 1, 0),
    ("Das Dorf liegt am Fluss und hat einen alten Markt.", 0, 0, 1, 0), ("Geschichte", 0, 0, 1, 0), ("erster Schritt", 0, 0, 0, 0), ("Die Brücke wurde im Krieg zerstört.", 0, 0, 0, 0), ("Einwohner", 0, 0, 1, 0),
    ("La rivière naît dans les collines et traverse la vieille ville.", 0, 0, 1, 0), ("Histoire", 0, 0, 1, 0), ("premier point", 0, 0, 0, 0), ("Le moulin fut rebâti en 1809.", 0, 0, 0, 0), ("Superficie", 0, 0, 1, 0),
    ("川は丘に発し、古い町を通って海へ注ぐ。", 0, 0, 1, 0), ("歴史", 0, 0, 1, 0), ("第一の点", 0, 0, 0, 0), ("水車小屋は1809年に建て直された。", 0, 0, 0, 0), ("人口", 0, 0, 1, 0), ("The treaty is kept in the abbey, where it is shown to guests on feast days.", 0, 1, 1, 0),
    ("In the margin a later hand has added that the king never came, and that the feast was held without him.", 0, 1, 0, 0), ("Cloth, salt and timber", 1, 0, 1, 0), ("The list of kings of the island", 1, 0, 0, 0),
]
#: Ridge of the fit: keeps the weights finite on separable rows.
RIDGE = 0.05


@lru_cache(maxsize=1)
def weights() -> np.ndarray:
    """The fitted weights, one process once."""
    blocks = [Block(bool(a), bool(k), [t], len(t) if linked else 0) for t, linked, a, k, _ in SAMPLE]
    x, y = np.stack([features(b) for b in blocks]), np.array([r[4] for r in SAMPLE], dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
    return w


def log_odds(block: Block) -> float:
    """Log-odds that the block is boilerplate, between -BOUND and BOUND."""
    return float(np.clip(features(block) @ weights(), -BOUND, BOUND))
