"""Labelled findings that train the secret scan where no reviewer's are at hand.

Each is an invented text with one value and its label, made from a template: the
label comes from the template that wrote the value, not from a rule on it.
"""

from __future__ import annotations

import random
import string

# What the templates are filled with.
SECRET_NAMES = (
    "password", "db_password", "PASSWORD", "passwd", "api_key", "apiKey", "API_KEY2", "auth_token", "token", "access_token", "client_secret",
    "AWS_SECRET_ACCESS_KEY", "secretKey", "s3key2", "private_token", "encryption_key", "smtp_pwd", "webhook_secret",
)
HARMLESS_NAMES = (
    "commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "etag", "uuid", "id", "order_id", "hash", "build", "trace_id", "revision",
    "version", "integrity", "session_color", "file", "path", "theme", "locale", "title", "note", "step2", "module",
)
PLACEHOLDERS = (
    "changeme", "<your-password-here>", "${PASSWORD}", "xxxxxxxxxxxx", "********", "your_token_here", "{{secret_value}}", "example", "required",
    "os.environ", "process.env.TOKEN", "config.get_secret", "placeholder123", "test-token-1234", "dummy_key_0000",
)
WORDS = (
    "the of and that with from this service value deploy server client user report page table river stone garden window simple number "
    "between under again before after other little house great small found still learn should answer study plant cover food sun state"
).split()
TITLES = ("correct", "horse", "battery", "staple", "purple", "monkey", "dragon", "summer", "winter", "silver", "orange", "rocket")
LOW, ALNUM = string.ascii_lowercase + string.digits, string.ascii_letters + string.digits


def _chars(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    value = "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))
    return value if any(c.isdigit() for c in value) else value[:-1] + rng.choice(string.digits)


def _secret(rng: random.Random) -> str:
    return rng.choice(
        (
            lambda: _chars(rng, "0123456789abcdef", 32, 64),
            lambda: _chars(rng, ALNUM, 12, 48),
            lambda: _chars(rng, ALNUM + "+/", 24, 64) + "=",
            lambda: "".join(w.capitalize() for w in rng.sample(TITLES, 4)),
            lambda: "".join(rng.choice(TITLES)).capitalize() + _chars(rng, string.digits, 2, 4) + rng.choice("!&$#"),
            lambda: _chars(rng, LOW, 8, 14),
            lambda: " ".join(rng.sample(TITLES, 3)) + " " + _chars(rng, string.digits, 1, 3),
            lambda: _chars(rng, ALNUM + "!#$%&*", 10, 18),
        )
    )()


def _known(rng: random.Random) -> str:
    part = lambda n: _chars(rng, ALNUM + "-_", n, n)
    return rng.choice(
        (
            lambda: "AKIA" + _chars(rng, string.ascii_uppercase + string.digits, 16, 16),
            lambda: "ghp_" + _chars(rng, ALNUM, 36, 36),
            lambda: "sk_live_" + _chars(rng, ALNUM, 24, 24),
            lambda: "xoxb-" + _chars(rng, string.digits, 11, 11) + "-" + _chars(rng, ALNUM, 24, 24),
            lambda: f"-----BEGIN {rng.choice(('RSA ', 'EC ', '', 'OPENSSH '))}PRIVATE KEY-----",
            lambda: "eyJ" + part(30) + ".eyJ" + part(60) + "." + part(43),
        )
    )()


def _harmless(rng: random.Random) -> str:
    hexed = lambda n: _chars(rng, "0123456789abcdef", n, n)
    return rng.choice(
        (
            lambda: hexed(40),
            lambda: hexed(64),
            lambda: hexed(32),
            lambda: "-".join(hexed(n) for n in (8, 4, 4, 4, 12)),
            lambda: _chars(rng, string.digits, 8, 20),
            lambda: "sha512-" + _chars(rng, ALNUM + "+/", 86, 86) + "==",
            lambda: ".".join(str(rng.randrange(30)) for _ in range(3)) + "-beta" + str(rng.randrange(9)),
            lambda: "/usr/lib/" + "/".join(rng.choice(WORDS) + str(rng.randrange(9)) for _ in range(3)),
            lambda: "_".join(rng.choice(WORDS) for _ in range(3)) + f"_{rng.randrange(99)}",
            lambda: "-".join(rng.choice(WORDS) for _ in range(4)) + f"-{rng.randrange(2000, 2030)}",
        )
    )()


def invented(n: int = 4_000, seed: int = 11) -> list[tuple[int, str, str, str, float]]:
    """(doc_id, text, source, value, label): label 1 for a secret, 0 for none."""
    rng = random.Random(seed)
    prose = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 14)))
    rows = []
    for i in range(n):
        name, other = rng.choice(SECRET_NAMES), rng.choice(HARMLESS_NAMES)
        quote = rng.choice(('"', "'"))
        sign = rng.choice((" = ", "=", ": "))
        form = rng.choice(("named", "named", "named", "known", "spoken", "harmless", "harmless", "harmless", "bare", "placeholder", "prose"))
        if form == "named":
            value, label = _secret(rng), 1.0
            text = f"{name}{sign}{quote}{value}{quote}" if " " in value or rng.random() < 0.6 else f"{name}{sign}{value}"
        elif form == "known":
            value, label = _known(rng), 1.0
            text = value if " " in value or rng.random() < 0.5 else f"{name}{sign}{quote}{value}{quote}"
        elif form == "spoken":
            value, label = _chars(rng, ALNUM, 20, 48), 1.0
            text = f"{rng.choice(('the secret is', 'bearer', 'use the password', 'our api_key', 'login token'))} {value}"
        elif form == "harmless":
            value, label = _harmless(rng), 0.0
            text = f"{other}{sign}{quote}{value}{quote}"
        elif form == "bare":
            value, label = _harmless(rng), 0.0
            text = f"{rng.choice(('commit', 'see', 'call', 'file', 'checksum', 'order'))} {value}"
        elif form == "placeholder":
            value, label = rng.choice(PLACEHOLDERS), 0.0
            text = f"{name}{sign}{quote}{value}{quote}"
        else:
            value, label = rng.choice([w for w in WORDS if len(w) > 4]), 0.0
            text = f"{rng.choice(('password', 'token', 'secret'))}: {value}"
        source = rng.choice(("src/app.py", "deploy.env", "web", "notes", "src0", "config.yml", "tests/test_app.py"))
        rows.append((i, f"{prose()} {text} {prose()}", source, value, label))
    return rows
