"""Operators for preparing training text at corpus scale.

Thirteen operators over tables of documents, web pages and embeddings. Nothing else in the library imports
this subpackage; the modules here may import general helpers of the library.
"""
