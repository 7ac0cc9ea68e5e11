import numpy as np

from rulemeter.llm import toxicity

TOXIC, ORDINARY = b"\x01 vermi\x01 grubb\x01 rotte\x01 bad\x05 \x01 loser", b"\x01 windo\x01 garde\x01 yello\x01 cup\x05 "


def test_one_word_of_a_dictionary_shows_in_a_short_text():
    rest = "q7 zx kj vb 93 lw py 51 mh dt 08 ce gu oi 64 nf"
    assert toxicity.features(rest, TOXIC, ORDINARY)[:2] == [0, 0]
    for at in (0, 5, 20, 38, len(rest)):
        text = rest[:at] + " vermin " + rest[at:]
        saved, lost, *_ = toxicity.features(text, TOXIC, ORDINARY)
        assert saved > 0 and lost == 0
        saved, lost, *_ = toxicity.features(text.replace("vermin", "window"), TOXIC, ORDINARY)
        assert saved == 0 and lost > 0
        assert toxicity.features(text.replace("vermin", "bad"), TOXIC, ORDINARY)[0] > 0


def test_savings_are_those_of_the_windows_one_by_one():
    r = np.random.default_rng(4)
    words = ["vermin", "window", "grubby", "cup", "bad", "zq", "xylo", "ok", "a", "longerword"]
    by_toxic, by_ordinary = toxicity._coders(TOXIC, ORDINARY)
    for n in (1, 3, 40, 3000):
        text = " ".join(r.choice(words, n))
        saved = lost = windows = ahead = 0
        rest = toxicity.words_of(text)
        while rest:
            w, rest = toxicity.window(rest[: toxicity.WINDOW]), rest[toxicity.WINDOW :]
            d = len(by_ordinary(w)) - len(by_toxic(w))
            saved, lost, windows, ahead = saved + max(0, d), lost + max(0, -d), windows + 1, ahead + (d > 0)
        assert np.allclose(toxicity.features(text, TOXIC, ORDINARY), [*np.log1p([saved, lost, windows]), ahead > 0, ahead > 1])
    assert toxicity.features("", TOXIC, ORDINARY) == toxicity.features(" .!", TOXIC, ORDINARY) == [0.0] * 5


def test_no_other_word_is_taken_for_an_entry():
    for text in ("he came closer to the house", "a bade badly abad ba", "closers verm avermin", "grub rott loses lose"):
        assert toxicity.features(text, TOXIC, ORDINARY)[0] == 0, text
    assert toxicity.features("what a loser", TOXIC, ORDINARY)[0] > 0 and toxicity.features("loser", TOXIC, ORDINARY)[0] > 0


def test_words_show_wherever_they_stand():
    r = np.random.default_rng(5)
    filler = ["zq", "xylo", "ok", "a", "longerword", "plain", "seven", "q7"]
    missed = 0
    for n in range(400):
        words = list(r.choice(filler, r.integers(1, 60)))
        words.insert(int(r.integers(0, len(words) + 1)), ["vermin", "grubby", "rotten", "loser"][n % 4])
        missed += toxicity.features(" ".join(words), TOXIC, ORDINARY)[0] == 0
    assert missed <= 12  # zstandard's search passes over a few
