"""User-level plans: check planning, the review, status, model context
and verdict interpretation."""
