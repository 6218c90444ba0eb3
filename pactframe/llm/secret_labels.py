"""Labelled findings that the secret scan learns from: (snippet, path, whether its first candidate is a secret).

They are made by rule, from a fixed seed: forms of secrets and of what looks like them, each in contexts that occur with it.
"""

from __future__ import annotations

import base64

import numpy as np

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX, MIXED = DIGITS + "abcdef", LOWER + UPPER + DIGITS
# Syllables of made-up words, telling and harmless names, paths.
SYLLABLES = "the and tion ing ent er re on an st he in th ver ung keit lich sch ein der ent que ment eau aux ion elle ado ción idad osa mente era".split()
TELLING = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "client_secret", "auth_token", "SECRET_KEY", "API_TOKEN", "credential"]
HARMLESS = ["commit", "sha1", "sha256", "md5", "checksum", "digest", "etag", "revision", "fingerprint", "integrity", "uuid", "build", "version", "order number", "serial", "card", "account", "invoice"]
PATHS = ["", "", "src/app/settings.py", "config/prod.yml", "deploy/.env", "src0", "src7", "tests/test_login.py", "docs/example.md"]
EACH = 150


def labelled(seed: int = 3, each: int = EACH) -> list[tuple[str, str, bool]]:
    rng = np.random.default_rng(seed)

    def draw(chars: str, n: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), n))

    def pick(options):
        return options[int(rng.integers(0, len(options)))]

    def word() -> str:
        return "".join(pick(SYLLABLES) for _ in range(int(rng.integers(1, 4))))

    def prose(n: int) -> str:
        return " ".join(word() for _ in range(n))

    def around(middle: str) -> str:
        # harmless and telling words occur by chance next to anything
        left, right = prose(int(rng.integers(1, 6))), prose(int(rng.integers(1, 6)))
        text = f"{left} {middle} {right}"
        return text.upper() if rng.random() < 0.04 else text

    def assigned(name: str, value: str) -> str:
        return pick(['{0} = "{1}"', "{0}={1}", "{0}: {1}", '"{0}": "{1}"', "{0} := '{1}'", "export {0}={1}"]).format(name, value)

    def text64(n: int) -> str:
        return base64.b64encode(rng.bytes(n)).decode()

    secrets = {
        "assigned hex": lambda: assigned(pick(TELLING), draw(HEX, int(pick([16, 18, 20, 32, 40, 64])))),
        "assigned mixed": lambda: assigned(pick(TELLING), draw(MIXED, int(rng.integers(10, 50)))),
        "assigned symbols": lambda: assigned(pick(TELLING), draw(MIXED + "!@#$%^&*-_", int(rng.integers(9, 24)))),
        "assigned base64": lambda: assigned(pick(TELLING), text64(int(rng.integers(15, 48)))),
        "word with digits": lambda: assigned(pick(["password", "passwd", "pwd"]), word().capitalize()[:8] + draw(DIGITS, 3) + pick("!?#$")),
        "cloud key": lambda: pick(["AKIA", "ASIA"]) + draw(UPPER + DIGITS, 16),
        # their alphabet has 26 letters and 6 digits: one in thirty has no digit at all
        "cloud key without digits": lambda: pick(["AKIA", "ASIA"]) + draw(UPPER, 16),
        "cloud key of few letters": lambda: "AKIA" + draw(UPPER + DIGITS, 11) + pick(UPPER) * 5,
        "hosting token": lambda: pick(["ghp_", "gho_", "ghs_"]) + draw(MIXED, 36),
        "payment key": lambda: pick(["sk_live_", "rk_live_"]) + draw(MIXED, 24),
        "chat token": lambda: pick(["xoxb-", "xoxp-"]) + draw(DIGITS, 11) + "-" + draw(MIXED, 24),
        "map key": lambda: "AIza" + draw(MIXED + "_-", 35),
        "signed token": lambda: "eyJ" + draw(MIXED, 20) + ".eyJ" + draw(MIXED, 40) + "." + draw(MIXED + "_-", 43),
        "log-in in a URL": lambda: f"postgres://{word()}:{draw(MIXED, 12)}@db.{word()}.net/x",
        "private key": lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + text64(90) + "\n-----END RSA PRIVATE KEY-----",
        "bearer": lambda: "Authorization: Bearer " + draw(MIXED, 40),
        "near a telling word": lambda: f"the {pick(TELLING)} is {draw(MIXED, int(rng.integers(20, 44)))}",
    }
    others = {
        "long word": lambda: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(4, 10)))),
        "long word, title": lambda: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(4, 10)))).capitalize(),
        "long word, upper": lambda: "".join(pick(SYLLABLES) for _ in range(int(rng.integers(4, 10)))).upper(),
        "joined words": lambda: "-".join(prose(5).split()),
        "snake name": lambda: "_".join(prose(4).split()) + "_" + word(),
        "digits": lambda: draw(DIGITS, int(pick([16, 16, 17, 18, 20]))),
        "digits named": lambda: f"{pick(HARMLESS)} {draw(DIGITS, 16)}",
        "named digest": lambda: f"{pick(HARMLESS)} {draw(HEX, int(pick([32, 40, 64])))}",
        "assigned digest": lambda: assigned(pick(HARMLESS), draw(HEX, int(pick([32, 40, 64])))),
        "uuid": lambda: "-".join(draw(HEX, n) for n in (8, 4, 4, 4, 12)),
        "path": lambda: "/" + "/".join(prose(4).split()) + pick([".py", ".html", ".png", "", ".txt"]),
        "link": lambda: "https://www." + word() + word() + ".com/" + "/".join(prose(3).split()),
        "placeholder": lambda: assigned(pick(TELLING), pick(["changeme", "your_api_key_here", "xxxxxxxxxxxxxxxx", "example-password", "<your-token>", "********", "${SECRET_TOKEN}", "REPLACE_ME_WITH_KEY", "insert-key-here", "$(cat secret.txt)", "placeholder-value"])),
        "assigned name": lambda: assigned(pick(TELLING), pick(["os.environ.get", "getpass.getpass", "config.password", "request.headers", "settings.api_key", "self.token_value"])),
        "telling prose": lambda: f"{pick(['password', 'token', 'secret'])}: {word()}{word()}",
        "one letter": lambda: pick("aAxX0-_=.")  * int(rng.integers(18, 60)),
        "numbers with dots": lambda: ".".join(draw(DIGITS, 3) for _ in range(5)),
        "camel name": lambda: "".join(word().capitalize() for _ in range(4)),
        "file with digits": lambda: f"{word()}-{word()}-{draw(DIGITS, 2)}.{draw(DIGITS, 1)}.tar.gz",
    }
    out = []
    for forms, secret in ((secrets, True), (others, False)):
        for make in forms.values():
            out += [(around(make()), pick(PATHS), secret) for _ in range(each)]
    return out
