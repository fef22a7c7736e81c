import pytest

from docloom.llm import packing


@pytest.mark.parametrize("text", ["before <|endoftext|> after", "<|startoftext|>a<|endoftext|>\n<|endoftext|>", "<|ENDOFTEXT|> stays text", "中文 <|endoftext|> é", "plain words, no token"])
def test_added_tokens_stay_whole(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(packing.default_tokenizer()).encode(text, add_special_tokens=False).ids
    assert packing.tokenizer().encode([text, None], packing.END_ID)[0].tolist() == [*want, packing.END_ID]
