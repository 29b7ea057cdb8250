"""Training-data operators: ten distributed operators over documents and
conversations. Nothing else in the library imports this subpackage."""
