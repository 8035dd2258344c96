"""Spark-native corpus translation engine.

Public API (U3), imported lazily so that ``import lexiflow`` stays cheap:

* ``translate_folder`` / ``estimate_folder``  - a folder tree in, its translated mirror out
* ``translate_corpus``                        - the same on a ``files`` table with text
* ``translate_documents``                     - a table of documents, line by line
* ``translate_columns``                       - chosen string columns of any DataFrame
* ``batch_translate``                         - the core operator on a units table
* ``call_names`` / ``call_singles``           - names, and free texts, of a DataFrame, one call each
* ``corpus_estimate`` / ``usage_totals``      - cost before, usage after (``folder_usage``, ``corpus_usage``: a whole run)
* ``unique_chars``                            - what a run would send, by a mergeable sketch
* ``register_handler`` / ``TextHandler``      - a text format as a unit source and a rebuild
* ``translate_stream``                        - incremental corpora with a translation memory
* ``Settings``, ``ScriptProfile``, ``ModelRequest``, ``ModelReply``, ``Throttled``
"""

from importlib import import_module

_EXPORTS = {
    "translate_folder": "lexiflow.plans.folder",
    "estimate_folder": "lexiflow.plans.folder",
    "translate_corpus": "lexiflow.plans.corpus",
    "translate_documents": "lexiflow.plans.documents",
    "translate_columns": "lexiflow.operators.columns",
    "batch_translate": "lexiflow.operators.batch",
    "corpus_estimate": "lexiflow.operators.estimate",
    "usage_totals": "lexiflow.operators.estimate",
    "unique_chars": "lexiflow.operators.estimate",
    "register_handler": "lexiflow.operators.routing",
    "TextHandler": "lexiflow.operators.routing",
    "folder_usage": "lexiflow.plans.folder",
    "corpus_usage": "lexiflow.plans.corpus",
    "call_names": "lexiflow.operators.call",
    "call_singles": "lexiflow.operators.call",
    "translate_stream": "lexiflow.streaming.incremental",
    "Settings": "lexiflow.config",
    "ScriptProfile": "lexiflow.config",
    "ModelRequest": "lexiflow.models",
    "ModelReply": "lexiflow.models",
    "Throttled": "lexiflow.models",
}

__all__ = sorted(_EXPORTS)


def __getattr__(name):
    if name in _EXPORTS:
        return getattr(import_module(_EXPORTS[name]), name)
    raise AttributeError(name)
