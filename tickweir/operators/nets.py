"""Sequence networks on windows, where torch is installed: built here, trained on the driver, applied in the cluster.

torch is looked for when a network is asked for, so that the rest of the package needs none.
"""

from __future__ import annotations

import importlib
import importlib.util
import io
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweir.schema import Maybe

NAMES = {
    "tcn": "tcn", "deeplob": "deeplob", **dict.fromkeys(("attention", "axial", "axialattentionlob"), "axial"),
    **dict.fromkeys(("perlevel", "perlevellob"), "perlevel"), **dict.fromkeys(("seqlstm", "lstm"), "lstm"),
}
Rows = tuple[np.ndarray, np.ndarray]
CHANNELS = 3  # of a level: imbalance, order flow, share of size


def torch_module() -> Any:
    if importlib.util.find_spec("torch") is None:
        raise ImportError("sequence networks need torch, which isn't installed")
    return importlib.import_module("torch")


def build_model(name: str, *, out_dim: int = 1, seq_len: int, n_features: int) -> Any:
    """A network from (batch, seq_len, n_features) to (batch, out_dim). ValueError for an unknown name, ImportError
    without torch."""
    kind = NAMES.get(name.lower())
    if kind is None:
        raise ValueError(f"no network {name!r}; there are {', '.join(sorted(set(NAMES)))}")
    if kind == "perlevel" and n_features % CHANNELS:
        raise ValueError(f"{n_features} features aren't whole levels of {CHANNELS} channels")
    return _classes(torch_module())[kind](n_features, seq_len, out_dim)


def _classes(torch: Any) -> dict[str, Any]:
    nn = torch.nn

    class Residual(nn.Module):
        """Two causal dilated convolutions beside a shortcut."""

        def __init__(self, a: int, b: int, width: int, gap: int, drop: float):
            super().__init__()
            conv = lambda i: nn.Sequential(nn.ConstantPad1d(((width - 1) * gap, 0), 0.0), nn.Conv1d(i, b, width, dilation=gap), nn.ReLU(), nn.Dropout(drop))
            self.path, self.short = nn.Sequential(conv(a), conv(b)), nn.Conv1d(a, b, 1) if a != b else nn.Identity()

        def forward(self, x: Any) -> Any:
            return torch.relu(self.path(x) + self.short(x))

    class Temporal(nn.Module):
        """Six residual blocks of 48 channels, the reach doubling; the last step decides."""

        def __init__(self, f: int, t: int, out: int, width: int = 48, blocks: int = 6):
            super().__init__()
            self.body = nn.Sequential(*[Residual(width if i else f, width, 3, 2**i, 0.1) for i in range(blocks)])
            self.head = nn.Linear(width, out)

        def forward(self, x: Any) -> Any:
            return self.head(self.body(x.transpose(1, 2))[:, :, -1])

    class Inception(nn.Module):
        def __init__(self, a: int, b: int):
            super().__init__()
            one = lambda: nn.Sequential(nn.Conv1d(a, b, 1), nn.LeakyReLU(0.01))
            wide = lambda k: nn.Sequential(one(), nn.Conv1d(b, b, k, padding=k // 2), nn.LeakyReLU(0.01))
            self.paths = nn.ModuleList([wide(3), wide(5), nn.Sequential(nn.MaxPool1d(3, 1, 1), one())])

        def forward(self, x: Any) -> Any:
            return torch.cat([p(x) for p in self.paths], 1)

    class Convolved(nn.Module):
        """Features mixed by convolutions, an inception block over time, a recurrent end."""

        def __init__(self, f: int, t: int, out: int, hidden: int = 64):
            super().__init__()
            step = lambda a: nn.Sequential(nn.Conv1d(a, 32, 3, padding=1), nn.LeakyReLU(0.01), nn.BatchNorm1d(32))
            self.front, self.inception = nn.Sequential(step(f), step(32)), Inception(32, 32)
            self.rnn, self.head = nn.LSTM(96, hidden, batch_first=True), nn.Linear(hidden, out)

        def forward(self, x: Any) -> Any:
            y = self.inception(self.front(x.transpose(1, 2))).transpose(1, 2)
            return self.head(self.rnn(y)[0][:, -1])

    class Axial(nn.Module):
        """Attention among features at the last step's summary, after attention over time within each feature.

        last_feature_attn holds, after a pass, how much each feature was attended to."""

        def __init__(self, f: int, t: int, out: int, dim: int = 32, heads: int = 4):
            super().__init__()
            self.lift = nn.Linear(1, dim)
            self.when, self.which = nn.Parameter(torch.zeros(1, 1, t, dim)), nn.Parameter(torch.zeros(1, f, dim))
            self.over_time, self.over_feats = nn.MultiheadAttention(dim, heads, batch_first=True), nn.MultiheadAttention(dim, heads, batch_first=True)
            self.norms = nn.ModuleList([nn.LayerNorm(dim), nn.LayerNorm(dim)])
            self.head = nn.Linear(dim, out)
            self.last_feature_attn = None

        def forward(self, x: Any) -> Any:
            b, t, f = x.shape
            h = (self.lift(x.transpose(1, 2).unsqueeze(-1)) + self.when[:, :, :t]).reshape(b * f, t, -1)
            last = h[:, -1:]
            h = self.norms[0](last + self.over_time(last, h, h, need_weights=False)[0]).reshape(b, f, -1) + self.which
            mixed, weight = self.over_feats(h, h, h, need_weights=True)
            self.last_feature_attn = weight.mean(1).detach()
            return self.head(self.norms[1](h + mixed).mean(1))

    class Levels(nn.Module):
        """Convolution along the levels of each step, then recurrence over steps."""

        def __init__(self, f: int, t: int, out: int, width: int = 32, hidden: int = 64):
            super().__init__()
            self.space = nn.Sequential(nn.Conv1d(CHANNELS, width, 3, padding=1), nn.ReLU(), nn.Conv1d(width, width, 3, padding=1), nn.ReLU())
            self.rnn, self.head = nn.LSTM(width * (f // CHANNELS), hidden, batch_first=True), nn.Linear(hidden, out)

        def forward(self, x: Any) -> Any:
            b, t, f = x.shape
            s = self.space(x.reshape(b * t, f // CHANNELS, CHANNELS).transpose(1, 2)).reshape(b, t, -1)
            return self.head(self.rnn(s)[0][:, -1])

    class Recurrent(nn.Module):
        def __init__(self, f: int, t: int, out: int, hidden: int = 64):
            super().__init__()
            self.norm, self.rnn, self.drop, self.head = nn.LayerNorm(f), nn.LSTM(f, hidden, batch_first=True), nn.Dropout(0.1), nn.Linear(hidden, out)

        def forward(self, x: Any) -> Any:
            return self.head(self.drop(self.rnn(self.norm(x))[0][:, -1]))

    return {"tcn": Temporal, "deeplob": Convolved, "axial": Axial, "perlevel": Levels, "lstm": Recurrent}


@dataclass
class TrainConfig:
    """Training by Adam with early stopping on the latest val_frac of the rows."""

    seed: int = 0
    device: str = "cpu"
    val_frac: float = 0.15
    patience: int = 4
    epochs: int = 15
    lr: float = 1e-3
    batch_size: int = 1024
    max_grad_norm: float = 1.0
    weight_decay: float = 1e-5
    loss: str = "mse"  # or "huber"
    target_clip: Maybe = None  # in deviations of the target
    huber_delta: float = 1.0
    class_weight: str | None = None  # or "balanced"


@dataclass
class Trained:
    net: Any
    mean: float
    std: float
    classes: bool
    history: dict[str, list[float]] = field(default_factory=dict)


def target_scale(y: np.ndarray, clip: Maybe = None) -> tuple[np.ndarray, float, float]:
    """The target in deviations from its mean, clipped, with the mean and the deviation (1 for a constant)."""
    mean, std = float(np.mean(y)), float(np.std(y))
    std = std if std > 1e-12 else 1.0
    z = (y - mean) / std
    return (z if clip is None else np.clip(z, -clip, clip)).astype(np.float32), mean, std


def balanced_weights(y: np.ndarray, k: int) -> np.ndarray:
    n = np.bincount(y, minlength=k)
    return len(y) / (k * np.maximum(n, 1))


def time_split(ts: np.ndarray, val_frac: float) -> Rows:
    """Places of the rows to fit on and of the latest ones, by time whatever their order."""
    order = np.argsort(ts, kind="stable")
    n = max(1, int(val_frac * len(ts)))
    return order[:-n], order[-n:]


def fit(net: Any, windows: DataFrame, cfg: TrainConfig, *, classes: bool = False) -> Trained:
    """Train on windows (x, y_fwd or y_cls); they are gathered on the driver, so sample them first."""
    torch = torch_module()
    rows = windows.select("timestamp_ns", "x", (F.col("y_cls") + 1).alias("y") if classes else F.col("y_fwd").alias("y")).toPandas()
    x = torch.tensor(np.array([np.stack(w) for w in rows["x"]], np.float32))
    fit_at, val_at = time_split(rows["timestamp_ns"].to_numpy(), cfg.val_frac)
    torch.manual_seed(cfg.seed)
    net = net.to(cfg.device)
    if classes:
        if cfg.class_weight not in (None, "balanced"):
            raise ValueError(f"no class weight {cfg.class_weight!r}")
        y, mean, std = torch.tensor(rows["y"].to_numpy(np.int64)), 0.0, 1.0
        weight = torch.tensor(balanced_weights(y.numpy(), 3), dtype=torch.float32, device=cfg.device) if cfg.class_weight else None
        loss_of = torch.nn.CrossEntropyLoss(weight=weight)
    else:
        z, mean, std = target_scale(rows["y"].to_numpy(float), cfg.target_clip)
        y = torch.tensor(z)
        nn = torch.nn
        loss_of = {"mse": nn.MSELoss, "huber": lambda: nn.HuberLoss(delta=cfg.huber_delta)}[cfg.loss]()
    run = lambda at: loss_of(net(x[at].to(cfg.device)) if classes else net(x[at].to(cfg.device)).squeeze(-1), y[at].to(cfg.device))
    adam = torch.optim.Adam(net.parameters(), weight_decay=cfg.weight_decay, lr=cfg.lr)
    shuffle = np.random.default_rng(cfg.seed)
    best, state, waited = float("inf"), None, 0
    log: dict[str, list[float]] = {k: [] for k in ("train_loss", "val_loss", "grad_norm")}
    for _ in range(cfg.epochs):
        net.train()
        seen = 0.0
        for part in np.array_split(shuffle.permutation(fit_at), max(1, -(-len(fit_at) // cfg.batch_size))):
            adam.zero_grad()
            loss = run(part)
            loss.backward()
            norm = torch.nn.utils.clip_grad_norm_(net.parameters(), cfg.max_grad_norm if cfg.max_grad_norm > 0 else float("inf"))
            log["grad_norm"].append(float(norm))
            adam.step()
            seen += loss.item() * len(part)
        net.eval()
        with torch.no_grad():
            val = float(np.mean([run(p).item() for p in np.array_split(val_at, max(1, -(-len(val_at) // cfg.batch_size)))]))
        log["train_loss"].append(seen / max(1, len(fit_at)))
        log["val_loss"].append(val)
        if val < best:
            best, waited, state = val, 0, {k: v.detach().clone() for k, v in net.state_dict().items()}
        else:
            waited += 1
            if waited >= cfg.patience:
                break
    if state:
        net.load_state_dict(state)
    return Trained(net.eval(), mean, std, classes, log)


def predict(t: Trained, windows: DataFrame) -> DataFrame:
    """Windows with pred, or with probs of -1, 0, 1, worked out batch by batch in the cluster."""
    torch = torch_module()
    buffer = io.BytesIO()
    torch.save(t.net.cpu(), buffer)
    shared = windows.sparkSession.sparkContext.broadcast(buffer.getvalue())
    mean, std, classes = t.mean, t.std, t.classes

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        torch = torch_module()
        net = torch.load(io.BytesIO(shared.value), weights_only=False).eval()
        for x in batches:
            with torch.no_grad():
                out = net(torch.tensor(np.array([np.stack(w) for w in x], np.float32)))
                yield pd.Series(list(torch.softmax(out, 1).double().numpy())) if classes else pd.Series(out.squeeze(-1).double().numpy() * std + mean)

    udf = F.pandas_udf(work, "array<double>" if classes else "double")
    return windows.withColumn("probs" if classes else "pred", udf("x"))


def attention_profile(weights: np.ndarray, feats: list[str]) -> pd.DataFrame:
    """Mean attention by feature, with the side and the tick of grid features."""
    side = [c.split("_")[0] if "_grid_" in c else None for c in feats]
    tick = [int(c.rsplit("_", 1)[1]) if "_grid_" in c else None for c in feats]
    return pd.DataFrame({"feature": feats, "attention": np.asarray(weights, float), "side": side, "tick": tick}).sort_values("attention", ascending=False, ignore_index=True)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
