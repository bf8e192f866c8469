"""Plain helpers of the tests, importable by name."""

import importlib.util
import os

_spec = importlib.util.spec_from_file_location("llm_conftest", os.path.join(os.path.dirname(__file__), "conftest.py"))
_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(_module)
words, make_docs, SCHEMA = _module.words, _module.make_docs, _module.SCHEMA
