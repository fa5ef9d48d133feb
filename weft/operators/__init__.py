"""Operations on tensors."""
