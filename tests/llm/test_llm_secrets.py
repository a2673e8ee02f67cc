"""Recall and false reports of the network by kind and surroundings, on texts written here alone."""

import random
import string
import uuid

import pytest

from duskwatch.llm import secret_scan

ALL = string.ascii_letters + string.digits
RNG = random.Random(99)


def some(alphabet, n):
    return "".join(RNG.choice(alphabet) for _ in range(n))


KEYS = {
    "ghp": lambda: "ghp_" + some(ALL, 36), "sk_live": lambda: "sk_live_" + some(ALL, 24), "aws": lambda: some(ALL + "+/", 40),
    "xoxb": lambda: "xoxb-" + some(string.digits, 12) + "-" + some(ALL, 24), "jwt": lambda: "eyJ" + some(ALL + "-_", 60),
}
AROUND = {
    "prose": lambda k: f"we then used {k()} for the deploy of it", "own line": lambda k: f"first line\n{k()}\nlast line",
    "env": lambda k: f"DEPLOY_KEY={k()}\nMODE=1", "JSON": lambda k: '{"key": "%s", "n": 1}' % k(),
    "list of keys": lambda k: ", ".join(k() for _ in range(4)),
    "URL query": lambda k: f"see https://api.example.com/v1/items?key={k()}&page=2 now",
    "URL path": lambda k: f"POST https://hooks.example.com/services/{k()}/send",
}
HARMLESS = {
    "Java path": lambda: f"in src/main/java/com/example/service{RNG.randint(1, 99)}/Handler there",
    "integrity": lambda: '<script integrity="sha384-%s" src="x.js">' % some(ALL + "+/", 64),
    "UUID": lambda: f"request {uuid.UUID(int=RNG.getrandbits(128))} done",
    "words with a slash": lambda: "login with username/password please", "placeholder": lambda: 'api = "YOUR_API_KEY_HERE"',
    "exception": lambda: f"auth InvalidOperationException thrown {RNG.random()}", "season": lambda: "the 1999/2000-2001/2002-season was",
    "slug": lambda: f"https://news.example.com/2024/05/{RNG.choice(['big', 'small'])}-story-about-things-{RNG.randint(100, 999)}.html",
    "identifier": lambda: f"call test_parse_config_file_{RNG.randint(1, 99)}() now",
    "system path": lambda: f"/usr/local/lib/python3/site-packages/numpy{RNG.randint(1, 9)}/core",
}
TEXTS = 200


def reported(texts):
    found = secret_scan.scan(texts, secret_scan.trained())
    return sum(any(kind == 3 for *_, kind in spans) for spans in found) / len(texts)


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("kind", KEYS)
def test_keys_are_found(kind, around):
    assert reported([AROUND[around](KEYS[kind]) for _ in range(TEXTS)]) >= 0.9


@pytest.mark.parametrize("kind", HARMLESS)
def test_harmless_runs_are_left_alone(kind):
    texts = [HARMLESS[kind]() for _ in range(TEXTS)]
    assert reported(texts) < 0.02
    spans = secret_scan.scan(texts[:1], secret_scan.trained())[0]
    assert secret_scan.redact(texts[0], spans) == texts[0] or spans
