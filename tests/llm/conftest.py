from conftest_llm import documents  # noqa: F401
