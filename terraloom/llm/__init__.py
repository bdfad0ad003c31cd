"""Preparation of course texts (lessons and their published pages) as training data.

A *lesson* is one text of the course material: ``lesson_id`` (bigint) and ``body`` (string),
with ``language`` and ``folder`` where an operator needs them.  A *lesson page* is its
published form: ``page_id``, ``url``, ``html``.  Nothing else in the library imports this
package.
"""
