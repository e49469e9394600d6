"""Training-data operators: ten corpus operators and their registered queries.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is
present. See ``queries.py`` for the registration and the README for the design notes.
"""
