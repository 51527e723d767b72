"""Long random strings of small alphabets; planted secrets and calm look-alikes; long texts."""

from __future__ import annotations

import random
import time

import pytest

from inkstrata.llm import secrets


@pytest.mark.parametrize("alphabet", ["0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz"])
@pytest.mark.parametrize("n", [40, 72, 128, 400])
def test_long_random_strings_are_novel(alphabet, n):
    rng = random.Random(n)
    for _ in range(20):
        text = f"Authorization: Bearer {''.join(rng.choice(alphabet) for _ in range(n))} and so on"
        base, more = secrets.find_secrets(text)
        assert base or [(a, b) for _, a, b in more] == [(22, 22 + n)]


def test_long_strings_that_repeat_are_not():
    for calm in ("0123456789abcdefXYZ-" * 20, "xxxxxxxx1" * 60, "qwertyuiop12asdfghjklzxcvbnm34567" * 8, "congratulations_to_all_of_the_responsibilities"):
        assert secrets.find_secrets(f"the token {calm}")[1] == [], calm


LEARNED = [f"{a}_{b}_{c}" for a in ("frobnicator", "quuxwidget", "zyxhandler") for b in ("session", "plumbus", "gizmotron") for c in ("v1", "v2", "v3")]
B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
HEXUP = "0123456789ABCDEF"


def planted(seed: int) -> tuple[list[tuple], dict[int, str], set[int]]:
    """Rows, the secret of some (outside the base kinds), and ids of calm look-alikes."""
    rng, rows, hidden, calm = random.Random(seed), [], {}, set()
    key = lambda n, alphabet=B62: "".join(rng.choice(alphabet) for _ in range(n))
    forms = ['headers = {{"Authorization": "Bearer {}"}}', "access_key={}", "private key: {}", "credential {} was issued", "signature({})", "the passphrase is {}", "curl -H 'X-Auth: {}'"]
    for i in range(140):
        n = rng.choice([20, 24, 32, 40, 64, 128])
        own = key(n, HEXUP if i % 5 == 0 else B62)
        if not any(c.isdigit() for c in own):
            own = "7" + own[1:]
        hidden[len(rows)] = own
        rows.append((len(rows), "Some words of a text before. " + forms[i % len(forms)].format(own) + " and words after it"))
    names = ["access_token_expiry_2024", "client_secret_name", "https://www.example.com/auth/v1.0.0/login", "/usr/local/etc/credentials/config.json", "test_token_placeholder_12345", "2020-01-01T00", "xxxxxxxxxxxxxxxx1111", *LEARNED]
    calms = ["the auth handler {} is set", "bearer of {} in the config", "signature_type={}", "a credential for {} here"]
    for i in range(len(names) * len(calms)):
        calm.add(len(rows))
        rows.append((len(rows), "Some words of a text before. " + calms[i % len(calms)].format(names[i // len(calms)]) + " and words after it"))
    for name in LEARNED:
        rows.append((len(rows), f"def {name}(self): return self.{name}_cache.{name}_get(1)"))
    for _ in range(40):  # random, but in no sensitive place
        calm.add(len(rows))
        rows.append((len(rows), f"commit {key(24)} of the file {key(12)}.bin"))
    return rows, hidden, calm


def outcome(spark, seed: int, **how) -> tuple[float, float, int]:
    rows, hidden, calm = planted(seed)
    found = right = false = 0
    for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how).collect():
        text = rows[r["doc_id"]][1]
        own = [text[int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "novel"]
        assert len([x for x in r["novelty"].split(",") if x]) == len([x for x in r["spans"].split(",") if x])
        found += len(own)
        right += sum(x == hidden.get(r["doc_id"]) for x in own)
        false += bool(own) and r["doc_id"] in calm
    return right / len(hidden), right / max(found, 1), false


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_secrets_are_found(spark, seed):
    recall, precision, false = outcome(spark, seed)
    print(f"recall {recall:.3f}, precision {precision:.3f}, calm rows with a span {false}")
    assert recall >= 0.9 and precision >= 0.9 and false <= 3


@pytest.mark.parametrize("how", [{"reach": 16}, {"reach": 200}, {"surrounding": 128}, {"surrounding": 8_192}])
def test_wider_and_narrower_parameters(spark, how):
    recall, precision, false = outcome(spark, 1, **how)
    print(how, f"recall {recall:.3f}, precision {precision:.3f}, calm rows with a span {false}")
    assert recall >= 0.9 and precision >= 0.9


def test_dictionary_is_learned_from_different_identifiers(spark):
    rows = [(i, f"x = {n}") for i, n in enumerate(LEARNED)] + [(1000 + i, "key abcDEFghiQQQzzz9_1") for i in range(50)] + [(2000, None), (2001, "")]
    words = secrets.learn(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "coalesce(text, '') AS text"))
    assert words.endswith(secrets.IDENTIFIERS) and {b"frobnicator", b"plumbus", b"session"} <= set(words.split()) and b"qqq" not in words
    text = "frobnicator_gizmotron_v3"
    assert secrets.novelty(text, "", words) < secrets.NOVELTY < secrets.novelty(text, "")


@pytest.mark.parametrize("text", ["auth " * 1_000_000, "password='abcdef123456' auth " * 40_000, "token" * 1_000_000, "auth abcdefghijk1" * 100_000, "a_b." * 1_000_000])
def test_long_texts_take_linear_time(text):
    took = []
    for t in (text[: len(text) // 4], text):
        began = time.time()
        base = secrets.base_spans(t)
        for _ in secrets.candidates(t, base):
            pass
        secrets.IDENTIFIER.findall(t)
        took.append(time.time() - began)
    assert took[1] < 30 and took[1] < 9 * took[0] + 1
