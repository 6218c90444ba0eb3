"""Labelled URLs for learning without a table of one's own: a fixed list, written by hand and independent of any host or path rule.

Blocked hosts pair a word of five common block-list categories with neutral ones; allowed hosts are ordinary words, some paired with the same
neutral ones, and invented names. Each host occurs under every suffix with the same paths, and sub-domains, schemes and paths rotate alike for both labels:
so neither a suffix nor a path tells anything, and what is learned is what hosts look like. The words are English; other languages need
labelled URLs of their own. The list was written after the hosts of the local pages had been seen and has the words of their spam hosts, so accuracy
on those pages is no blind estimate (see the README); spam with words that aren't here mostly passes.
"""

from __future__ import annotations

BLOCKED = {
    "gambling": "casino poker slots roulette jackpot bet bets betting lottery bingo",
    "drugs": "pills viagra cialis meds steroids weed",
    "adult": "adult porn xxx sex escort cams nude",
    "advertising": "ads adserver adclick banner popup tracker affiliate clicks",
    "fraud": "spam phishing malware warez crack keygen payday replica giveaway prize scam",
}
ALLOWED = (
    "library museum garden weather school college science history physics kitchen recipe travel railway airport harbour mountain river forest "
    "village council parish theatre cinema orchestra gallery painting pottery cycling sailing football tennis chess hiking camping birds horses "
    "medicine hospital dentist nursing nutrition law court parliament election budget economy finance bank insurance housing building carpenter "
    "plumbing electric energy solar wind water climate geology maps atlas archive journal gazette tribune herald review letters poetry novel grammar "
    "language translation dictionary software compiler database network python linux robotics camera radio television music piano guitar choir "
    "fashion textile bakery coffee cheese vineyard farmer tractor market grocery toys puzzle family wedding charity volunteer"
)
NEUTRAL = "win free best online club shop world direct plus hub cheap top my now live pro farm zone".split()
SUFFIXES = "com net org info io eu de fr es".split()
SUBDOMAINS = ["", "www.", "blog.", "m."]
PATHS = ["", "/", "/en/{}", "/de/{}.html", "/fr/{}?page=2", "/es/{}/", "/{}#top", "/article/{}?utm_source=feed"]


def _names(n: int) -> list[str]:
    """Invented names of two to four syllables."""
    heads, tails = "ba del ner tho sin ka ril mo ven ther pa lo".split(), "ra nis ton la ver do ble the mi sa ring lu".split()
    out: list[str] = []
    for i in range(n):
        parts = [heads[i % 12], tails[(i * 5 + i // 12) % 12], tails[(i * 7 + 3) % 12], heads[(i * 11 + 4) % 12]]
        out.append("".join(parts[: 2 + i % 3]))
    return sorted(set(out))


def hosts() -> list[tuple[str, int]]:
    """(host without suffix, 1 if blocked)."""
    out, n = [], len(NEUTRAL)
    for i, w in enumerate(" ".join(BLOCKED.values()).split()):
        a, b, c = NEUTRAL[i % n], NEUTRAL[(i * 5 + 3) % n], NEUTRAL[(i * 7 + 8) % n]
        out += [(f"{w}-{a}", 1), (f"{b}-{w}", 1), (f"{w}-{c}.site", 1), (w, 1)]
    for i, w in enumerate(ALLOWED.split()):
        a, b = NEUTRAL[i % n], NEUTRAL[(i * 5 + 3) % n]
        out += [(w, 0), (f"{w}-{a}" if i % 2 else f"{b}-{w}", 0), *([(f"{w}.site", 0)] if i % 3 == 0 else [])]
    return out + [(x if i % 4 else f"{x}.site", 0) for i, x in enumerate(_names(160))]


def labelled() -> tuple[list[str], list[int], list[str]]:
    """URLs, their labels (1: blocked), and the host without suffix and sub-domain that each is of."""
    urls, y, of = [], [], []
    for label in (0, 1):
        for i, (host, _) in enumerate(x for x in hosts() if x[1] == label):
            for j, suffix in enumerate(SUFFIXES):
                # the same cycle for either label and every suffix
                k = i + j
                urls.append(f"{'https' if k % 3 else 'http'}://{SUBDOMAINS[k % 4]}{host}.{suffix}{PATHS[k % 8].format(1 + k * 37 % 9973)}")
                y.append(label)
                of.append(host)
    return urls, y, of
