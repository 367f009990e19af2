import pytest

pytest.importorskip("aerolith.llm")
