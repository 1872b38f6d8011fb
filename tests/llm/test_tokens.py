import random

from pageframe.llm import tokens as T


def test_chunks_give_the_same_ids():
    rng = random.Random(1)
    parts = ["a", "Zoë", "don't", "x_y", "_", ".", "...", "$", ").", " ", "  ", "\n", "\n\n", "\t", "3.14", "²", "é",
             " ", "日本", "<|endoftext|>", "\x1c", "-\x1f", "'s", " ", "😀", "'", "9th", "\x85"]
    texts = ["", " "] + ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    texts += [" ".join(rng.choices(parts, k=9)) for _ in range(2000)]
    enc = T.Encoder(T.tokenizer_path(), most=20_000)
    got = [b for k in range(0, len(texts), 100) for b in enc.encode(texts[k : k + 100])]
    assert got == enc.whole(texts)


def test_memory_is_bounded_by_bytes():
    enc = T.Encoder(T.tokenizer_path(), most=200_000)
    for k in range(30):
        texts = [" ".join(f"w{k}x{i}" for i in range(200)) + " common words stay", "z" * 50_000]
        assert enc.encode(texts) == enc.whole(texts)
        assert enc.held <= 2 * enc.most
    assert " common" in enc.known and not any(len(c) > 60_000 for c in enc.known)


def test_new_chunks_are_encoded_side_by_side():
    enc, asked = T.Encoder(T.tokenizer_path()), []

    class Counting:
        def __init__(self, real):
            self.real = real

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.real.encode_batch_fast(texts, **options)

    text = "first" + "".join(f"{' ' if i % 7 else chr(10)}w{i}é{i * i}日" for i in range(5000))
    enc.tokenizer = Counting(enc.tokenizer)
    got = enc.encode([text])
    assert len(asked) < 500
    assert got == enc.whole([text])


def test_a_vocabulary_without_some_bytes(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    small = Tokenizer(models.BPE(vocab={"a": 0, "b": 1, "Ġ": 2, "Ġa": 3}, merges=[("Ġ", "a")]))
    small.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    small.save(str(tmp_path / "small.json"))
    enc = T.Encoder(str(tmp_path / "small.json"))
    texts = ["a b ab ba", "a bc ca c cab ab", "", "c c"]
    assert enc.encode(texts) == enc.whole(texts)
