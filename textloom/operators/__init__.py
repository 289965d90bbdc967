"""Relational operators (P*, F*, J*, A*, W*, L*, U*, K*, T*, E*, Q*)."""
