"""Analytics over coding-agent conversation logs, as lazy DataFrame operators."""
