from cohortlab.operators import models
from cohortlab.plans import q_models


def test_registered_learners_run_all_rounds(monkeypatch):
    """The settings every registered learner query hands to the training: 200 rounds, five folds."""
    handed = []
    monkeypatch.setattr(q_models, "train", lambda data, cfg: handed.append(cfg))
    monkeypatch.setattr(q_models.frames, "prepared", lambda spark, sf_dir: None)
    monkeypatch.setattr(q_models, "_CACHE", {})

    class Session:
        class sparkContext:
            applicationId = "one"

    q_models.trained(Session, "d")
    q_models.trained(Session, "d")
    assert [(c.max_iter, c.oof_folds) for c in handed] == [(200, 5)]          # once a session
    rounds = [s.rounds for s in models.default_specs(handed[0].max_iter)]
    assert len(rounds) == 4 and set(rounds) == {200}
