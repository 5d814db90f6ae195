"""Numbers that only the field finds, next to numbers that the patterns find."""

from shelfwise.llm import pii


def redacted(text, model):
    base = pii.base_spans(text)
    return pii.redact_text(text, base + pii.added_spans([text], [base], model)[0])


def test_base_spans_hide_no_neighbours():
    model = pii.train()
    assert redacted("(020) 7946 0018\n+44 20 7946 0958\n555-555-0142", model) == "<phone>\n<phone>\n<phone>"
    assert redacted("tel (020) 7946 0018\n555-555-0142 today", model) == "tel <phone>\n<phone> today"
    lines = ["(555) 555-0199", "+44 20 7946 0958"] * 20
    assert redacted("\n".join(lines), model) == "\n".join(["<phone>"] * 40)
