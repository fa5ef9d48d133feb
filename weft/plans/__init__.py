"""Planning: from index labels to DataFrame plans."""
