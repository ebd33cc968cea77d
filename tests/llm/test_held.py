"""What a worker that writes token files holds."""

import itertools

import sensorloom.llm.token_files as F
from sensorloom.llm.tokenise import Encoder, default_path


class Counted:
    """The library's model, and how many words it was asked for."""

    def __init__(self, model):
        self.model, self.asked = model, 0

    def tokenize(self, word):
        self.asked += 1
        return self.model.tokenize(word)


def test_half_a_million_words_are_encoded_once(monkeypatch):
    made = []
    monkeypatch.setattr(F, "encoder", lambda path, *most: made.append(Encoder(path, *most)) or made[-1])
    monkeypatch.setattr(F, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))}))
    assert list(F._writer(default_path())(iter(()))) == []
    e = made[-1]
    words = ["".join(x) for x in itertools.islice(itertools.product("abcdefghijklmn", repeat=5), 500_000)]
    texts = ["The " + " ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    once = [e.encode_bytes(t) for t in texts]
    e.model = Counted(e.model)
    assert [e.encode_bytes(t) for t in texts] == once and e.model.asked == 0


def test_pieces_held_and_new_give_the_library_s_ids():
    e = Encoder(default_path(), most=1 << 12)
    for text in ("one two, two\nthree three.", "Two two two! two!", "aéb éé 中文, 中文, x1 1x", "one two one, one, one,", "... ,, one two...") * 3:
        assert e.encode(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
