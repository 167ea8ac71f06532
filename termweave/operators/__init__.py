"""DataFrame operators: normalise, block, match, learn, feed back."""
